"""Content-digest analytics as PySpark DataFrame transformations."""
