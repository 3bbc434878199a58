"""Spark-native engine for labelled sparse-matrix datasets and the queries around them."""

__version__ = "0.1.0"
