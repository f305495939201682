"""Spark-native analytics for collections of short social posts."""

__version__ = "0.1.0"
