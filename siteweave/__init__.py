"""Whole-site structured-data integrity and corpus preparation on Spark DataFrames."""
