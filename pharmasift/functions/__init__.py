"""Column expression builders; none of them uses a Python UDF."""
