"""Training-data operators: scans, dedup, scoring, mixing, sharding, packing, search.

Nothing outside this subpackage imports it; it can be deleted as a unit.
"""
