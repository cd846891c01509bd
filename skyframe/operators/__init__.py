"""Operators on DataFrames of tiles, mosaics, metrics and catalogues."""
