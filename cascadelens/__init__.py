"""cascadelens: a Spark-native engine for software composition and vulnerability propagation."""

__version__ = "0.1.0"
