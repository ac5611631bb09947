"""Larger plans: the import of a statement, and the registered queries."""
