"""A PySpark-native data engine for corpora of financial documents and training text."""
