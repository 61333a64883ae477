"""orderlens operators."""
