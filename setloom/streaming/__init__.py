"""Incremental growth of an index from a stream."""
