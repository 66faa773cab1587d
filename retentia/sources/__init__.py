"""Reading deliveries and writing tables."""
