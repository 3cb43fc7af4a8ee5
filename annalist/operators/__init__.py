"""Operators over ledgers, as functions from DataFrames to DataFrames."""
