"""Column functions: pure expressions, no shuffles and no Python per row."""
