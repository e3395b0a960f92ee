"""Relational pieces: nested paths, flattening, slices of a statement and its order."""
