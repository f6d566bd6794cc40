"""Spatial statistics of multi-channel images with labelled cells, many images at once, on Spark."""
