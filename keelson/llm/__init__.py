"""Training-data operators: deduplication, quality, language, packing, mixing.

Nothing else in the library imports this subpackage.
"""
