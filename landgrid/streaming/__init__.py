"""Incremental versions for streams of objects."""
