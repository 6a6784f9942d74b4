"""Operators for preparing text corpora: near-dedup, search, packing, mixing, scoring, formatting, redaction."""
