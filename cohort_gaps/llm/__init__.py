"""Operators for training-data pipelines over text and embeddings. Nothing else in the library imports this package."""
