"""Incremental runs over streams of references."""
