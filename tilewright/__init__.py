"""Tilewright: geospatial interlinking on Spark DataFrames."""
