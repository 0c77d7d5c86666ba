"""Column functions and small array helpers."""
