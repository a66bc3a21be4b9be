"""Raster analytics on Spark: images as DataFrames of pixels, operators as declarative plans."""
