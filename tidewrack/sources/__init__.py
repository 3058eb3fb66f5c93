"""Readers and writers of the domain's files, on Spark's own sources."""
