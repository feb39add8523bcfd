"""Granary: JSON column operators for PySpark."""
