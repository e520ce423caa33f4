"""Rules on unbounded input."""
