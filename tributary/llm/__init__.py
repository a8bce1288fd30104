"""Training-data operators: dedup, archives, packing, mixing, scoring and search.

Nothing outside this subpackage imports it. Every operator is a function from
DataFrames to a DataFrame; `tributary.llm.queries` binds them to the tables.
"""
