"""Bout analytics on Spark: head-to-head contest data as DataFrames."""
