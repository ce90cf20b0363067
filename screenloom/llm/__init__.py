"""Operators of a training-data pipeline: text, vectors, conversations."""
