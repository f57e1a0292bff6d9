"""Operators of a training-data pipeline: see the module of each."""
