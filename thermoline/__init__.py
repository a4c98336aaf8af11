"""Thermoline: recovery analytics over ordered measurement series, built on Spark DataFrames."""

__version__ = "0.1.0"
