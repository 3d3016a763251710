"""Plumbline: static analysis of SQL corpora with Spark DataFrames."""
