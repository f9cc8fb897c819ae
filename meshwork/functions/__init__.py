"""Statistics and ranking measures."""
