"""Part of barlake."""
