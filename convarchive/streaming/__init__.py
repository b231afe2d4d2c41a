"""Streaming of the archive library."""
