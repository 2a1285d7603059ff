"""Operators for preparing training text: cleaning, counting, deduplication, packing and mixing.

Nothing else in the library imports this subpackage.
"""
