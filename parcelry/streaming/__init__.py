"""Incremental application to streams of changes."""
