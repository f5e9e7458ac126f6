"""Operators over DataFrames: each takes tables and gives a table, and runs nothing by itself."""
