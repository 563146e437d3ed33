"""Training-data operators: deduplication, language ID, extraction, sharding, tokenising, packing.

Nothing else in the library imports this subpackage; delete the folder and the
rest still works.
"""
