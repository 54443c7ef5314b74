"""The stored index and text output."""
