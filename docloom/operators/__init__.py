"""Relational operators over the tables of the index."""
