"""Aggregates with SPARQL semantics: sums and averages of nothing are 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_bound(value: Column) -> Column:
    return F.count(value)


def count_distinct_solutions(*values: Column) -> Column:
    """COUNT(DISTINCT *): unbound parts count as a value of their own."""
    return F.count_distinct(F.struct(*values))


def sum0(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def avg0(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def group_concat(value: Column, separator: str = " ", distinct: bool = False) -> Column:
    """The values in order (the standard leaves it open), joined; empty for none."""
    values = F.collect_set(value) if distinct else F.collect_list(value)
    return F.array_join(F.array_sort(values), separator)


def sample(value: Column) -> Column:
    """Any value; the smallest, so that runs agree."""
    return F.min(value)
