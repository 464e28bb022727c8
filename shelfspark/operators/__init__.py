"""Circulation operators. Each takes a ``Library`` (and parameters) and returns a lazy DataFrame."""
