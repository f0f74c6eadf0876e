"""Training-data pipeline operators: search, filtering, deduplication, scoring and packing.

Nothing else in the package imports this subpackage.
"""
