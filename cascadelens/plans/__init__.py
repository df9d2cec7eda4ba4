"""Queries with their SQL equivalents."""
