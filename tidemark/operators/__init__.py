"""Relational operators over archive listings."""
