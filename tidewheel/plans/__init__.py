"""Plans: what is computed in which order."""
