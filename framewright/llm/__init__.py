"""Operators for preparing training data, each with its registered query."""
