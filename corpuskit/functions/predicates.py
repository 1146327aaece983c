"""Predicates over metadata, relevance and repositories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(where: dict) -> Column:
    """Column test for a metadata filter.

    ``{"field": value}``, ``{"field": {"$eq": value}}``, ``{"$and": [...]}``
    and ``{"$or": [...]}``.  Plain comparisons, so the scan can push them down.
    """
    tests = []
    for field, value in where.items():
        if field == "$and":
            tests.append(reduce(Column.__and__, [matches(w) for w in value]))
        elif field == "$or":
            tests.append(reduce(Column.__or__, [matches(w) for w in value]))
        elif isinstance(value, dict):
            tests.append(F.col(field) == value["$eq"])
        else:
            tests.append(F.col(field) == value)
    return reduce(Column.__and__, tests)


def relevant(collection: Column, score: Column, rules: dict[str, tuple[int, float]]) -> Column:
    """Score above the threshold of its collection; ``rules`` is collection -> (k, threshold)."""
    test = F.lit(False)
    for name, (_, threshold) in rules.items():
        test = test | ((collection == name) & (score > threshold))
    return test


def cross_repo(source: Column, target: Column) -> Column:
    return target.isNotNull() & (target != source)
