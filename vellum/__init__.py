"""vellum: Spark-native analytics over scholarly text, documents and property graphs."""

__version__ = "0.1.0"
