"""Registered queries: one key per operator, each with its SQL twin."""

from corpuskit.catalog.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
