"""Training-data operators: quality, safety, deduplication, mixing, packing and output.

Nothing else in the library imports this subpackage.
"""
