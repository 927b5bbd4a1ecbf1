"""Scalar functions: missing values, safe arithmetic, types, text, time and categories."""
