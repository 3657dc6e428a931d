"""Operators on record tables: DataFrame to DataFrame."""
