"""Training-data operators: search, dedup, sharding, tokenising, archives, mixing, quality, extraction.

Nothing outside this subpackage imports it.
"""
