"""Operators that prepare recognised text as training data.  Nothing outside this package imports it."""
