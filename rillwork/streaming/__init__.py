"""Continuous change logs through Structured Streaming."""
