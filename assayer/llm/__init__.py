"""Training-data operators: near duplicates, mixing, archives, text, filters, search and sharding.

Nothing outside this subpackage imports it; its queries are in :mod:`assayer.llm.queries`.
"""
