"""Operators for preparing training data: fingerprints, deduplication, sharding, mixing, tokens, quality.

Every module holds one operator with its own interface; ``queries`` registers
one query per operator over the table ``documents``. Nothing else in the
library imports this subpackage.
"""
