"""Readers of listings, index tables and object content."""
