"""Operators for preparing training data, each with its query and SQL."""
