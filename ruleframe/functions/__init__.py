"""Scalar functions of the language, for values and for columns."""
