"""Planar geometry analytics on Spark DataFrames."""
