"""Relational operators over listings, observations, labels and photos."""
