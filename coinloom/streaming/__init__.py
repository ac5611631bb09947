"""The readers on a stream of statement documents."""
