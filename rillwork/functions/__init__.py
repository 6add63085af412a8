"""Scalar functions and the formula language."""
