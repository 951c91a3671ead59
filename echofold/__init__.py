"""Spark-native perceptual near-duplicate detection."""

__version__ = "0.1.0"
