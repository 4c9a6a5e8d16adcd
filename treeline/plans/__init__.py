"""Logical descriptions of queries."""
