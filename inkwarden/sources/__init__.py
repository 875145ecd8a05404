"""Sources of inkwarden."""
