"""Training-data operators: filtering, deduplication, mixing and packing of text corpora.

Nothing outside this subpackage imports it.
"""
