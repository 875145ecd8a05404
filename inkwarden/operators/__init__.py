"""Operators of inkwarden."""
