"""quern: a Spark-native engine for document search and corpus analytics."""

__version__ = "0.1.0"
