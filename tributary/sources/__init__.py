"""Parquet sources and sinks."""
