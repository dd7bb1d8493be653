"""tesselith: Spark-native analytics for sequences of array-valued records."""

__version__ = "0.1.0"
