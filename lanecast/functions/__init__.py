"""Scalar expressions: Column -> Column."""
