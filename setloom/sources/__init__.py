"""Readers that give sequences, postings or tables of counts."""
