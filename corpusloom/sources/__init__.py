"""Readers and writers that bring a corpus into DataFrames and results out of them."""
