"""orderlens functions."""
