"""Operators that join, aggregate, rank or fit; they take and return DataFrames."""
