"""Experiments over a stream of pair numbers."""
