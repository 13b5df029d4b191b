"""Column functions: text, numbers, coverage features."""
