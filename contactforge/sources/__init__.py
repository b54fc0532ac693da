"""Readers for sequences, community profiles and machine quality profiles."""
