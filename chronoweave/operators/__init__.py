"""Operators on message tables: DataFrame in, DataFrame out."""
