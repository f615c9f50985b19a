"""Relational algebra over sequences, sets, maps, text and graphs, on Spark DataFrames."""
