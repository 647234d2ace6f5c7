"""lexloom: a PySpark-native engine that turns long legal documents into cited evidence."""

__version__ = "0.1.0"
