"""Feature families: each takes bars with what it needs and returns them with its columns."""
