"""Training-data operators: extraction, deduplication, filters, scans and mixing.

Nothing else in the library imports this subpackage.
"""
