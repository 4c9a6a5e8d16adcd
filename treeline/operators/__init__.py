"""Counting, joining, direct access, building blocks, privacy bounds and padding."""
