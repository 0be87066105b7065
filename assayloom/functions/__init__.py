"""Scalar column functions and the fixed schema vocabulary."""
