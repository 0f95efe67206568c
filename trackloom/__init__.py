"""Paired-trajectory analytics and data-quality operators on Spark DataFrames."""
