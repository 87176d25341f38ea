"""Operators on free text for training-data pipelines. Nothing outside imports this package."""
