"""Readers (and the matching writers) of the data model's sources."""
