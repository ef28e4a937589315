"""Spark jobs for engineering list data."""
