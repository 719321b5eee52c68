"""Column functions and result shaping."""
