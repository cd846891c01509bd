"""Column functions on pixel values, pixel arrays and sky positions."""
