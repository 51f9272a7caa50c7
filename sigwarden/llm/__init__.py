"""Operators for training-data pipelines: deduplication, media columns, sharding,
language identification, mixing, tokenization, URL filtering and chat formatting.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
