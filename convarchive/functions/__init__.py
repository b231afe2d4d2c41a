"""Functions of the archive library."""
