"""Document analytics on DataFrames."""
