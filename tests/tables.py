"""The tables that core tests read."""

TABLES = "/root/testdata/sf0.001"
