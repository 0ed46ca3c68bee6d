"""Operators for training-data pipelines on text. Nothing else in the package imports them."""
