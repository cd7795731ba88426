"""Training-data operators: deduplication, tokenising, packing, personal data, sharding, media, toxicity.

Nothing else in the library imports this subpackage.
"""
