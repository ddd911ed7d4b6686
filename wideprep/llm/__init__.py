"""Training-data operators: text extraction, scoring, deduplication, mixing, formatting, sharding.

Nothing else in the library imports this subpackage.
"""
