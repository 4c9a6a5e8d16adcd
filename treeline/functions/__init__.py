"""Scalar functions and table maintenance."""
