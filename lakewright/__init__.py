"""lakewright: a PySpark-native engine for layered, self-checking record pipelines."""

__version__ = "0.1.0"
