"""Operators for training-data pipelines over documents, pages, conversations and vectors."""
