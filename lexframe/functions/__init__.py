"""Column functions of the domain."""
