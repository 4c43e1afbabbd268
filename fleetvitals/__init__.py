"""Audit engine for fleets of relational databases, written on Spark DataFrames."""
