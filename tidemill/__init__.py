"""Tick-data lake analytics on Spark DataFrames."""
