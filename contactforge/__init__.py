"""Proximity-ligation sequencing experiments as relational data processing on Spark."""
