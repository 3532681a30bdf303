"""Column functions: no data moves, nothing but expressions."""
