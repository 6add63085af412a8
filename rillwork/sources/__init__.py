"""Change logs, readers and the tables that hold state."""
