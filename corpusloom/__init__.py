"""Corpus question answering analytics on Spark DataFrames."""
