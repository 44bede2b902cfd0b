"""Interval, path and graph analytics written with PySpark DataFrames."""
