"""Composite jobs a user calls."""
