"""brindle: a Spark-native text search and text analytics engine."""

__version__ = "0.1.0"
