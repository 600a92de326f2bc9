"""Column functions and tails of distributions."""
