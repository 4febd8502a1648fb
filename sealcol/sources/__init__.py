"""Reading and writing sealed tables."""
