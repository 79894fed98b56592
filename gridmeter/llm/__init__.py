"""Training-data operators: extraction, deduplication, scoring, mixing, sharding and encoding.

Nothing else in gridmeter imports this subpackage.
"""
