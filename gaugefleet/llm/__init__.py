"""Training-data operators: packing, dedup, filtering, extraction, sanitising and archives.

Nothing else in the library imports this subpackage.
"""
