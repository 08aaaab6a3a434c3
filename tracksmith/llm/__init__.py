"""Operators that prepare large text corpora: deduplication, scoring, mixing, packing.

Nothing else in the library imports this subpackage.
"""
