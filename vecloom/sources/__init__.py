"""Files of vectors, and indexes as tables."""
