"""Column functions and Arrow-batched text functions."""
