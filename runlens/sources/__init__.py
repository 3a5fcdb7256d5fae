"""Readers of raw run folders and of stored relations."""
