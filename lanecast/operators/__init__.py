"""Operators: DataFrame -> DataFrame, column names as arguments."""
