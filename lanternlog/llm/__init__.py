"""Operators for text corpora and pairwise results; nothing outside imports this package."""
