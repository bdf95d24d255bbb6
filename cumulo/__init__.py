"""Soft clustering and feature engineering on Spark DataFrames."""
