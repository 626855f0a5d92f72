"""Readers and writers: ZIP metadata, member content, canonical JSON, extraction trees."""
