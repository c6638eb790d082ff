"""Plant objects composed from the operators: each is a function from DataFrames to a DataFrame."""
