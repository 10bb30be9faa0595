"""Training-data operators: sharding, dedup, scans, decontamination, scoring, packing.

Nothing outside this package imports it.
"""
