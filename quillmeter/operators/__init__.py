"""Operators over DataFrames: filters, joins, aggregates, windows and set operations."""
