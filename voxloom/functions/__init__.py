"""See the README for the map of modules."""
