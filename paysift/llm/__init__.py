"""Operators for preparing text corpora: near-duplicate search, packing,
quality rules, language identification, source mixing, classification,
sharding, token files and substring removal.

Nothing else in the library imports this subpackage.
"""
