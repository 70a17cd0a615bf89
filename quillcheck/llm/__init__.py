"""Operators for training-data pipelines. Nothing else in quillcheck imports this package."""
