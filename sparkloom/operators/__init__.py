"""Operators that Spark lacks as such, composed of DataFrame operations."""
