"""Column functions over entry names."""
