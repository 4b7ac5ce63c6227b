"""A PySpark engine for procedural image analytics, coding and training data."""
