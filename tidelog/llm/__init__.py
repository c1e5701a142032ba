"""Training-data operators: deduplication, search, extraction, quality, mixing, packing, scoring, chat.

Nothing else in the library imports this subpackage; deleting it leaves the log engine whole.
"""
