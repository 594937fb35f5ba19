"""Training-data operators: tokens, sharding, deduplication, quality, language and packing.

Nothing outside this subpackage imports it.
"""
