"""Operators for training-data corpora; nothing outside this folder imports them.

Queries and their SQL checks are registered by `taintgrid.llm.queries`.
"""
