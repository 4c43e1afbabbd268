"""Operators on text corpora for training data, and the queries that apply them."""
