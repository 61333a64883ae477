"""orderlens sources."""
