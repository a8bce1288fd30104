"""Exact column expressions."""
