"""Lodging analytics as PySpark DataFrame functions."""
