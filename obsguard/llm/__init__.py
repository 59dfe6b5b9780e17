"""Operators for preparing large text corpora: scoring, mixing, sharding, deduplication, search.

Nothing else in the library imports this subpackage. `queries.py` registers one query per operator.
"""
