"""millrace: a PySpark-native engine for curating, splitting, scheduling and analysing training data."""

__version__ = "0.1.0"
