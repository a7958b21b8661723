"""Raster analytics on Spark: collections of images kept as pixel tables."""

__version__ = "0.1.0"
