"""Keeping the index up to date from a stream of listing files."""
