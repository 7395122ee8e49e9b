"""Scalar functions as column expressions, and their driver-side counterparts for single strings."""
