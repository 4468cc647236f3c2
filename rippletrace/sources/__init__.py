"""Readers and writers of artifacts."""
