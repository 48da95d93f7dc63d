"""Training-data operators: mixing, scoring, joins, dedup, formatting, packing.

Nothing else in the package imports this subpackage.
"""
