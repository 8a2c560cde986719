"""Retrieval over collections of text, images and feature vectors, as PySpark DataFrame operators."""
