"""Lossless schema convergence and row provenance on Spark."""
