"""Operators for preparing training text: each works on DataFrames and is independent of the rest of the library."""
