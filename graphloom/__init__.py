"""A PySpark engine for source-code graphs."""
