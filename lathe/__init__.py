"""lathe: a Spark-native engine for tidying source text and preparing corpora."""

__version__ = "0.1.0"
