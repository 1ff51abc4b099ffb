"""Corpus-preparation operators for training text. Nothing else in the library imports this package."""
