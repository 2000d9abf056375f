"""Training-data operators: sharding, language id, fingerprints, extraction, dedup, tokenization, quality.

Nothing outside this subpackage imports it.
"""
