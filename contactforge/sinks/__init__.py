"""Writers for reads, profiles and reports."""
