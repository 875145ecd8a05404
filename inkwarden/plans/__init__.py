"""Plans of inkwarden."""
