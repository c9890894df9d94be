"""Workload analytics on Spark DataFrames."""
