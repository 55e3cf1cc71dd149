"""Readers of pages, office files and corpora."""
