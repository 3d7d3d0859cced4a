"""Operators for the preparation of training corpora; nothing else in the library imports this package."""
