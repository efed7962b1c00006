"""Exact percentiles per group by bisection, and counts of cells that combine across partitions and days."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.session import Spool, col

#: Intervals are broadcast up to this number of rows (some 50 bytes each); beyond it they are joined by shuffling.
MOST_BROADCAST = 200_000
#: Parts that the rows of a group are divided into where they are shuffled.
SALTS = 32
#: Cells of all intervals together that a pass counts at most, unless each has but 16.
MOST_CELLS = 1 << 19


def _same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond &= a[n].eqNullSafe(b["r" + n])
    return cond


def _renamed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({n: "r" + n for n in names})


def _within(data: DataFrame, intervals: DataFrame, rows: int, names: Sequence[str]) -> DataFrame:
    """The rows in each of their group's intervals. Where these are too many to broadcast, the rows of a group are spread over SALTS parts, to each of which its intervals are given."""
    if rows <= MOST_BROADCAST:
        on, intervals = F.lit(True), F.broadcast(intervals)
    else:
        data = data.withColumn("salt", F.pmod(F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(SALTS)))
        intervals = intervals.withColumn("rsalt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        on = data["salt"] == intervals["rsalt"]
    return data.join(intervals, on & _same(data, intervals, names) & data["v"].between(intervals["rlo"], intervals["rhi"])).drop("salt", "rsalt")


def _cell(v: Column, lo: Column, hi: Column, cells: int, whole: bool) -> Column:
    """The cell of [lo, hi] that v is in: never falling as v grows, 0 at lo, cells - 1 at hi."""
    width = hi.cast("double") - lo.cast("double")
    share = (v.cast("double") - lo.cast("double")) / width
    if whole:  # neighbours that are one and the same as doubles
        share = F.when(width > 0, share).otherwise((v - lo).cast("double") / F.when(hi > lo, (hi - lo).cast("double")))
    return F.least(F.floor(share * cells), F.lit(cells - 1)).cast("int")


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float], continuous: bool = True, tolerance: float = 0.0, levels: int | None = None, spool: Spool | None = None
) -> DataFrame:
    """keys, p, n, v: the p-quantile of value in each group, exact up to ``tolerance``, by bisection.

    For each group and wanted rank an interval of values is maintained. Each pass counts, per group and interval,
    the rows below the midpoints of the next ``levels`` bisections (2 ** levels cells at once; from 4 to 12, as many as the number of
    intervals allows within MOST_CELLS), so that a pass narrows an interval 2 ** levels times; the new interval is the least and greatest value found in the cell that
    holds the rank. It ends when all intervals are single values or at most ``tolerance`` wide. Counts are combined
    on the map side, and passes read only the keys and values, written once to the shared folder; a group of a third
    of all rows is counted like any other. Groups and intervals stay distributed, only the number of open ones comes to the driver.

    continuous: interpolated between the two ranks around p (n - 1), as percentile_cont; else the value of rank ceil(p n), as
    percentile_disc. The error is at most ``tolerance``, which is also the bound after merging, as counts below a midpoint add up
    over any division of the rows. value: any numeric type; integers stay exact (results are doubles if continuous).
    Null and NaN values take no part, a group without others has no row; infinite values have their rank (next to one, interpolation gives it). A null key is a group of
    its own. Repeated rows count each time. An empty table gives no rows. Names of other columns do not matter.
    """
    spool = spool or Spool(df.sparkSession)
    kind = df.schema[value].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    names = [f"k{i}" for i in range(len(keys))]
    v = col(value).cast("bigint") if whole else col(value).cast("double")
    rows = df.select(*(col(k).alias(n) for k, n in zip(keys, names)), v.alias("v")).where("v is not null" if whole else "v is not null and not isnan(v)")
    data, _ = spool.write(rows)
    finite = F.lit(True) if whole else (F.abs("v") < float("inf"))
    groups = data.groupBy(*names).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~finite & (F.col("v") < 0)).alias("low"), F.count_if(finite).alias("inside"), F.min(F.when(finite, F.col("v"))).alias("lo"), F.max(F.when(finite, F.col("v"))).alias("hi")
    )
    groups = groups.where("n > 0")  # without keys an empty table has a group too
    wanted = F.explode(F.array(*(F.lit(float(p)) for p in ps)))
    at = groups.select(*names, "n", "low", "inside", "lo", "hi", wanted.alias("p"))
    if continuous:
        exact = F.col("p") * (F.col("n") - 1)
        at = at.withColumn("weight", exact - F.floor(exact)).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(exact) + 1, F.ceil(exact) + 1))))
    else:
        at = at.withColumn("weight", F.lit(0.0)).withColumn("rank", F.greatest(F.ceil(F.round(F.col("p") * F.col("n"), 9)), F.lit(1).cast("bigint")))
    # infinite values are told by their rank alone
    low, high = F.col("rank") <= F.col("low"), F.col("rank") > F.col("low") + F.col("inside")
    fixed = F.when(low, float("-inf")).when(high, float("inf"))
    if not whole:
        at = at.withColumns({"lo": F.coalesce(fixed, "lo"), "hi": F.coalesce(fixed, "hi")})
    state, path = spool.write(at.withColumn("below", F.col("low")).drop("low", "inside"))
    open_now = (F.col("lo") < F.col("hi")) & (F.col("hi").cast("double") - F.col("lo").cast("double") > tolerance) if tolerance > 0 else F.col("lo") < F.col("hi")
    while open_rows := state.where(open_now).select(*names, "lo", "hi").distinct().count():
        cells = 2 ** (levels or min(12, max(4, int(math.log2(MOST_CELLS / open_rows)))))
        intervals = _renamed(state.where(open_now).select(*names, "lo", "hi").distinct(), [*names, "lo", "hi"])
        near = _within(data, intervals, open_rows, names)
        counts = (
            near.withColumn("cell", _cell(F.col("v"), F.col("rlo"), F.col("rhi"), cells, whole))
            .groupBy(*("r" + n for n in names), "rlo", "rhi", "cell")
            .agg(F.count(F.lit(1)).alias("rows"), F.min("v").alias("new_lo"), F.max("v").alias("new_hi"))
        )
        over = Window.partitionBy(*("r" + n for n in names), "rlo", "rhi").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("upto", F.sum("rows").over(over))
        holds = _same(state, counts, [*names, "lo", "hi"]) & state["rank"].between(state["below"] + counts["upto"] - counts["rows"] + 1, state["below"] + counts["upto"])
        narrowed = state.where(open_now).join(counts, holds).select(
            *names, "n", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), "p", "weight", "rank", (F.col("below") + F.col("upto") - F.col("rows")).alias("below")
        )
        new, new_path = spool.write(narrowed.unionByName(state.where(~open_now)))
        spool.drop(path)
        state, path = new, new_path
    middle = F.col("lo") if tolerance == 0 else F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((F.col("lo") + F.col("hi")) / 2)
    best = state.groupBy(*names, "p").agg(F.first("n").alias("n"), F.first("weight").alias("weight"), F.min_by(middle, "rank").alias("a"), F.max_by(middle, "rank").alias("b"))
    between = F.when(F.col("a") == float("-inf"), float("-inf")).when(F.col("b") == float("inf"), float("inf")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("weight"))
    v = F.when(F.col("a") == F.col("b"), F.col("a").cast("double")).otherwise(between) if continuous else F.col("a")
    return best.select(*(F.col(n).alias(k) for n, k in zip(names, keys)), "p", "n", v.alias("v"))


def count_cells(df: DataFrame, keys: Sequence[str], value: str, bits: int = 7) -> DataFrame:
    """keys, cell, rows: how many values of a group lie in each cell, a bisection of every power of two into 2 ** bits cells.

    Such counts of separate days or partitions are combined by ``merge_cells``. A group has at most as many rows as cells, whatever
    its number of values. Null and NaN values take no part; infinite ones count in the outermost cells.
    """
    x = col(value).cast("double")
    size = F.abs(x)
    power = F.when(size == float("inf"), 1100).otherwise(F.floor(F.log2(F.when(size > 0, size)))).cast("bigint")
    part = F.when(size == float("inf"), 0).otherwise(F.floor((size / F.pow(F.lit(2.0), power) - 1) * 2**bits)).cast("bigint")
    cell = F.when(size == 0, 0).otherwise(F.signum(x).cast("bigint") * ((power + 1200) * 2**bits + part))
    return df.where(col(value).isNotNull() & ~F.isnan(x)).groupBy(*(col(k).alias(k) for k in keys), cell.alias("cell")).agg(F.count(F.lit(1)).alias("rows"))


def merge_cells(*parts: DataFrame) -> DataFrame:
    """The counts of all parts together; all of the same keys and bits."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*(col(c).alias(c) for c in whole.columns if c != "rows")).agg(F.sum("rows").alias("rows"))


def cell_percentiles(cells: DataFrame, ps: Sequence[float], bits: int = 7) -> DataFrame:
    """keys, p, n, v from the counts of ``count_cells`` or ``merge_cells``: the middle of the cell that holds rank ceil(p n).

    The relative error against the value of that rank is at most 2 ** -(bits + 1). A group's window holds one row per cell.
    """
    keys = [c for c in cells.columns if c not in ("cell", "rows")]
    by = Window.partitionBy(*(col(k) for k in keys))
    upto = F.sum("rows").over(by.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    run = cells.withColumn("upto", upto).withColumn("n", F.sum("rows").over(by)).withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in ps))))
    rank = F.greatest(F.ceil(F.round(F.col("p") * F.col("n"), 9)), F.lit(1).cast("bigint"))
    held = run.where((F.col("upto") >= rank) & (F.col("upto") - F.col("rows") < rank))
    size = F.abs("cell")
    power = F.floor(size / 2**bits) - 1200
    middle = F.when(power >= 1100, float("inf")).otherwise(F.pow(F.lit(2.0), F.least(power, F.lit(1023))) * (1 + (F.pmod(size, F.lit(2**bits)) + 0.5) / 2**bits))
    return held.select(*(col(k) for k in keys), "p", "n", F.when(F.col("cell") == 0, 0.0).otherwise(F.signum(F.col("cell").cast("double")) * middle).alias("v"))
