"""Operators of a training-data pipeline (search, mixing, near-dedup, filters, archives, packing).

Nothing outside this subpackage imports it.
"""
