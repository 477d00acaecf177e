"""Training-data operators: deduplication, filtering, scoring, tokenizing.

Nothing outside this subpackage imports it.
"""
