"""A PySpark library for archives of AI conversations and the material around them."""
