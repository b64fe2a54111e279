"""Claim and narrative analytics on Spark DataFrames."""
