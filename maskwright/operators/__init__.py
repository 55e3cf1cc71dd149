"""Operators over documents and their spans."""
