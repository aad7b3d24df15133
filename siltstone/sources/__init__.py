"""Siltstone sources."""
