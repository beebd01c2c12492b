"""Gridded and mesh-based data processing on PySpark DataFrames."""
