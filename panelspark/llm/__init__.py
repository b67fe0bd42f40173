"""Operators for preparing training text: near-duplicates, packing, mixing, scoring, search."""
