"""Lodestone: governed retrieval and analytics as PySpark DataFrames."""
