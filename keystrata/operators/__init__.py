"""Operators over versioned keyed logs, each a function of DataFrames."""
