"""Sievecraft: corpus curation operators for Spark DataFrames."""
