"""Column functions over texts and JSON."""
