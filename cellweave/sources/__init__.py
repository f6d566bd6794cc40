"""Pixel, mask and cell tables, and their checks."""
