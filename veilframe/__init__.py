"""veilframe: a PySpark-native privacy analytics engine."""

__version__ = "0.1.0"
