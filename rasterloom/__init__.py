"""Raster analytics expressed as Spark DataFrame plans."""
