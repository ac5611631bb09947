"""Operators on accounts, transactions and parsed statements."""
