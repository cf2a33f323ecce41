"""Abandoned-basket analytics as Spark jobs: every step takes and returns DataFrames."""

__version__ = "0.1.0"
