"""Extraction, sketching, set overlap, selection."""
