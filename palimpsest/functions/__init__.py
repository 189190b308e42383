"""Column functions: text scalars, vector arithmetic and fixed parameters."""
