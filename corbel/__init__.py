"""A PySpark engine for linking label texts, drug names and conditions."""
