"""Operators for preparing large text collections as training data."""
