"""Scalar functions on columns, all from built-in Spark functions."""
