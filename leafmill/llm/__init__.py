"""Operators for large text corpora: mixing, filters, deduplication, extraction.

Nothing outside this package imports it.
"""
