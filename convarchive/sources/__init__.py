"""Sources of the archive library."""
