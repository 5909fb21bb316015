"""Readers and writers of the pipeline files."""
