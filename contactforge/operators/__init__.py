"""Relational operators: digestion, weights, lookups, slices, reads, errors."""
