"""Totals and means over trailing periods of days, days without rows included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.session import col


def daily_totals(df: DataFrame, entity: Sequence[str], day: str, value: str) -> DataFrame:
    """(entity..., day, rows, n, total) of the rows with a day and all entity columns; a null or NaN value adds nothing to n and total."""
    present = col(day).isNotNull()
    for e in entity:
        present &= col(e).isNotNull()
    v = F.nanvl(col(value).cast("double"), F.lit(None).cast("double"))
    return (
        df.where(present)
        .select(*(col(e).alias(f"e{i}") for i, e in enumerate(entity)), col(day).cast("date").alias("day"), v.alias("v"))
        .groupBy(*(f"e{i}" for i in range(len(entity))), "day")
        .agg(F.count(F.lit(1)).alias("rows"), F.count("v").alias("n"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"))
    )


def rolling_totals(df: DataFrame, entity: Sequence[str], day: str, value: str, periods: Sequence[int] = (7, 30), per_quarter: bool = False) -> DataFrame:
    """For each entity and day, what the trailing periods (that day and the p - 1 before) hold.

    Rows are first added up by entity and day, on the map side as well, so a heavy entity costs no more than its
    days. Each daily total is exploded onto the output dates it influences, as many as the longest
    period, and added up by entity and date with one conditional sum per period; the calendar of the entity is left-joined
    to that, so days without any influence come out as zero.

    The calendar goes from an entity's first day with a row to its last; with per_quarter=True it does so within every
    calendar quarter that has a row, from the quarter's first day. A row whose value is null counts as a row of the day.
    Rows without a day or with a null entity column are left out; repeated rows count each time, so drop them before
    if they are faults. No rows give no result. Names of other columns of df do not matter.
    Result: entity..., day (date), and for each p total_<p>d (0 if nothing), n_<p>d, mean_<p>d (null if n is 0).
    """
    if not periods or min(periods) < 1:
        raise ValueError("periods must be positive numbers of days")
    keys = [f"e{i}" for i in range(len(entity))]
    daily = daily_totals(df, entity, day, value)
    ahead = daily.select(*keys, "n", "total", F.explode(F.sequence(F.lit(0), F.lit(max(periods) - 1))).alias("d"), "day").withColumn("day", F.date_add("day", F.col("d")))
    sums = [f(F.when(F.col("d") < p, F.col(c))).alias(f"{c}_{p}d") for p in periods for f, c in ((F.sum, "total"), (F.sum, "n"))]
    influenced = ahead.groupBy(*keys, "day").agg(*sums)
    span = [*keys, F.date_trunc("quarter", "day").cast("date").alias("from")] if per_quarter else keys
    first = F.col("from") if per_quarter else F.min("day")
    calendar = daily.groupBy(*span).agg(first.alias("lo"), F.max("day").alias("hi")).select(*keys, F.explode(F.sequence("lo", "hi")).alias("day"))
    joined = calendar.join(influenced, [*keys, "day"], "left")
    out = [F.col(k).alias(e) for k, e in zip(keys, entity)] + [F.col("day")]
    for p in periods:
        out += [F.coalesce(f"total_{p}d", F.lit(0.0)).alias(f"total_{p}d"), F.coalesce(f"n_{p}d", F.lit(0)).cast("bigint").alias(f"n_{p}d"), F.when(F.col(f"n_{p}d") > 0, F.col(f"total_{p}d") / F.col(f"n_{p}d")).alias(f"mean_{p}d")]
    return joined.select(*out)
