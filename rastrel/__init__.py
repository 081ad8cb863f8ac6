"""Raster-to-vector analytics on Spark DataFrames."""
