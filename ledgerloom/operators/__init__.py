"""Operators over DataFrames; each takes its column names as parameters."""
