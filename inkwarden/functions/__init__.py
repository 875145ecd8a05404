"""Functions of inkwarden."""
