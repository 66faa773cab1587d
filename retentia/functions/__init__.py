"""Column functions: parsing, normalising, formatting and rules."""
