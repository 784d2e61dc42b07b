"""Column functions: urls and text."""
