"""Column functions and order statistics."""
