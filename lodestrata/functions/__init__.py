"""Column functions: text in, Columns out; no UDF."""
