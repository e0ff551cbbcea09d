"""The same queries over unbounded input."""
