"""Column helpers built from Spark's own functions; none is a Python UDF."""
