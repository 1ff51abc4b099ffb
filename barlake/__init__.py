"""Part of barlake."""

__version__ = "0.2.0"
