"""Operators of the archive library."""
