"""Column functions and the language catalogue."""
