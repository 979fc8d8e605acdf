"""Mutation-testing analytics on Spark DataFrames."""
