"""Aggregates of a group to columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.functions.expressions import NUMERIC, Typed, text_of
from tidegraph.sparql import algebra as A


class UnknownAggregate(ValueError):
    """An aggregate has no implementation."""


def _number(x: Typed) -> Column:
    return x[0].try_cast("double") if isinstance(x[1], T.StringType) else x[0]


def in_order(value: Column, by: Sequence[str], distinct: bool = False) -> Column:
    """The group's values that are not null as an array, in order of the columns ``by`` and, where these tie, of the values."""
    if distinct:
        return F.array_sort(F.collect_set(value))
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*(F.col(b).alias(f"o{i}") for i, b in enumerate(by)), value.alias("v")))))
    return F.transform(rows, lambda r: r["v"])


def aggregate(a: A.Aggregate, value: Typed | None, everything: Sequence[str], by: Sequence[str], own: dict[str, Callable[[Column, Sequence[str]], Column]]) -> Column:
    """The column of an aggregate; ``value`` is its argument, ``everything`` the group's columns, ``by`` its columns of time."""
    if a.name == "COUNT":
        if value is None:
            return F.count_distinct(F.struct(*everything)) if a.distinct else F.count(F.lit(1))
        return F.count_distinct(value[0]) if a.distinct else F.count(value[0])
    if a.name == "SUM":
        v = _number(value)
        if isinstance(value[1], T.DecimalType):
            v = v.cast("double")
        return F.coalesce(F.sum_distinct(v) if a.distinct else F.sum(v), F.lit(0))
    if a.name == "AVG":
        v = _number(value).cast("double") if value[1] is None or isinstance(value[1], (*NUMERIC, T.StringType)) else value[0]
        return F.sum_distinct(v) / F.count_distinct(v) if a.distinct else F.avg(v)
    if a.name in ("MIN", "MAX"):
        return (F.min if a.name == "MIN" else F.max)(value[0])
    if a.name == "SAMPLE":  # any value will do; the least one is the same at every run
        return F.min(value[0])
    if a.name == "GROUP_CONCAT":
        return F.array_join(in_order(text_of(value), by, a.distinct), a.separator)
    if a.name in own:
        return own[a.name](value[0], by)
    raise UnknownAggregate(f"aggregate {a.name} is not known")
