"""Training-data operators: search, scans, packing, mixing, dedup, classification, filters.

Nothing outside this subpackage imports it; each module holds one operator
with a general interface, and ``queries`` wires them to the corpus tables.
"""
