"""Statement text and stored tables."""
