"""Collections as weighted sets of rows, and their operators as DataFrame plans."""
