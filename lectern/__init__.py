"""Lectern: a document query engine on Spark DataFrames."""
