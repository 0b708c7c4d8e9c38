"""Column functions and the fixed rules that they apply."""
