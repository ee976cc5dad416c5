"""Column functions over texts and spans."""
