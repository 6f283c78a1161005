"""Operators over the log: DataFrame in, DataFrame out."""
