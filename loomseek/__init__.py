"""A Spark-native hybrid retrieval engine over note corpora."""

__version__ = "0.1.0"
