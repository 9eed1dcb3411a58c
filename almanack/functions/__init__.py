"""Column functions on text, dates and hashes."""
