"""Spark-native analytics for cascaded stream moderation and change detection."""

__version__ = "0.1.0"
