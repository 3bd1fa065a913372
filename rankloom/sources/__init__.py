"""Readers: export files, fetched documents and stored facts."""
