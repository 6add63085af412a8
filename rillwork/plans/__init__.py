"""Dependency graph, delta rules and the catalogue of queries."""
