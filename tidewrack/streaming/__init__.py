"""Incremental work: resumable tables and file streams."""
