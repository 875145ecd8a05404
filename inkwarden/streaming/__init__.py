"""Streaming of inkwarden."""
