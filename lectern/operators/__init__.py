"""Operators of the document engine. Each takes and gives DataFrames."""
