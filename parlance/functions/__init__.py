"""Column functions used by several operators."""
