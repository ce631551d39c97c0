"""Training-data operators: scoring, filtering, near-duplicate search, packing, mixing and sharding.

Nothing else in the library imports this subpackage. Every operator is a plain function from
DataFrames to DataFrames; the thin contract queries live in :mod:`seqloom.llm.registry`.
"""
