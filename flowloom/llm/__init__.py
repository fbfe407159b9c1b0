"""Training-data operators: filtering, deduplication, packing and token encoding.

Nothing outside this subpackage imports it.
"""
