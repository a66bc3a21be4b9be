"""Operators for preparing training text, built on DataFrames; nothing else in the library imports this."""
