"""Operators for large-scale training text: pair defects, sampling, splits, near-duplicates, overlaps,
encoding, mixing and splitting. Nothing outside this package imports it."""
