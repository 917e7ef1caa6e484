"""Training-data operators: deduplication, mixing, scoring, packing, extraction and search.

Nothing outside this subpackage imports it; removing the folder leaves the
rest of the library whole.
"""
