"""Composite queries built from the operators."""
