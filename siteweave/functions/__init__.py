"""Column functions: scalars of call tables, sequence features, and special functions."""
