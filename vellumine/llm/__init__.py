"""Training-data operators: extraction, deduplication, mixing, language ID, tokens, shards.

Nothing else in the package imports this subpackage.
"""
