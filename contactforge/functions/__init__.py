"""Column functions: draws, sequence functions, distributions."""
