"""orderlens plans."""
