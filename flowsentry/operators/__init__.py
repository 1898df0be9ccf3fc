"""Batch operators: plain functions from DataFrames to a DataFrame."""
