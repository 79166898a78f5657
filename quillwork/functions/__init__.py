"""Scalar functions over columns: text, arrays and names."""
