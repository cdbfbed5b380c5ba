"""loomwork: a Spark-native engine for curating, searching and evaluating text collections."""

__version__ = "0.1.0"
