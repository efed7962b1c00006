"""Per-key statistics in key order when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.session import col, ship

_STATE = "k {k}, part bigint, n_rows bigint, n_values bigint, v_min {v}, v_max {v}, v_sum {v}, first_o bigint, last_o bigint, first_v {v}, last_v {v}, max_gap bigint, change {v}"


def _ends(ok: np.ndarray, starts: np.ndarray, last: bool) -> np.ndarray:
    """Of each run the place of its first (last) true element, -1 where there is none."""
    n = len(ok)
    at = np.arange(n)
    if last:
        return np.maximum.reduceat(np.where(ok, at, -1), starts)
    first = np.minimum.reduceat(np.where(ok, at, n), starts)
    return np.where(first == n, -1, first)


def _steps(x: np.ndarray, ok: np.ndarray, run: np.ndarray, runs: int, absolute: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of each run the largest step and the sum of steps between the elements that are ok."""
    at = np.flatnonzero(ok)
    most, total = np.full(runs, -1, x.dtype), np.zeros(runs, x.dtype)
    if len(at) > 1:
        same = run[at[1:]] == run[at[:-1]]
        step = (x[at[1:]] - x[at[:-1]])[same]
        step = np.abs(step) if absolute else step
        np.maximum.at(most, run[at[1:]][same], step)
        np.add.at(total, run[at[1:]][same], step)
    return most, total


_NAMES = [f.split()[0] for f in _STATE.split(", ")]


def _summaries(batch: pa.RecordBatch, value_type: str) -> dict[str, pa.Array]:
    """The columns of one partial state for each run of equal keys in a sorted batch."""
    kind = np.int64 if value_type == "bigint" else np.float64
    k, o, v = (batch.column(i) for i in range(3))
    n = batch.num_rows
    prev, here = k.slice(0, n - 1), k.slice(1)
    differs = pc.or_(pc.fill_null(pc.not_equal(prev, here), False), pc.xor(pc.is_null(prev), pc.is_null(here)))
    starts = np.concatenate([[0], np.flatnonzero(differs.to_numpy(zero_copy_only=False)) + 1])
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    o_ok, v_ok = (pc.is_valid(x).to_numpy(zero_copy_only=False) for x in (o, v))
    o, x = (pc.fill_null(c, 0).to_numpy(zero_copy_only=False).astype(t) for c, t in ((o, np.int64), (v, kind)))
    top, low = (np.iinfo(kind).max, np.iinfo(kind).min) if kind is np.int64 else (np.inf, -np.inf)
    both = o_ok & v_ok
    gap, _ = _steps(o, o_ok, run, len(starts), False)
    _, change = _steps(x, both, run, len(starts), True)
    values = np.add.reduceat(v_ok.astype(np.int64), starts)
    at = lambda a, i: pa.array(a[np.maximum(i, 0)], mask=i < 0)
    return {
        "k": k.take(pa.array(starts)), "n_rows": pa.array(np.diff(np.append(starts, n))), "n_values": pa.array(values),
        "v_min": pa.array(np.minimum.reduceat(np.where(v_ok, x, top), starts), mask=values == 0), "v_max": pa.array(np.maximum.reduceat(np.where(v_ok, x, low), starts), mask=values == 0),
        "v_sum": pa.array(np.add.reduceat(np.where(v_ok, x, 0), starts)), "max_gap": pa.array(gap, mask=gap < 0), "change": pa.array(change),
        "first_o": at(o, _ends(o_ok, starts, False)), "last_o": at(o, _ends(o_ok, starts, True)), "first_v": at(x, _ends(both, starts, False)), "last_v": at(x, _ends(both, starts, True)),
    }


def _least(a, b, pick=min):
    return a if b is None else b if a is None else pick(a, b)


def _stitch(a: dict, b: dict) -> dict:
    """The state of a run that goes on from one batch into the next."""
    gap = None if a["last_o"] is None or b["first_o"] is None else b["first_o"] - a["last_o"]
    over = 0 if a["last_v"] is None or b["first_v"] is None else abs(b["first_v"] - a["last_v"])
    return {
        "k": a["k"], "n_rows": a["n_rows"] + b["n_rows"], "n_values": a["n_values"] + b["n_values"], "v_min": _least(a["v_min"], b["v_min"]), "v_max": _least(a["v_max"], b["v_max"], max), "v_sum": a["v_sum"] + b["v_sum"],
        "first_o": b["first_o"] if a["first_o"] is None else a["first_o"], "last_o": a["last_o"] if b["last_o"] is None else b["last_o"],
        "first_v": b["first_v"] if a["first_v"] is None else a["first_v"], "last_v": a["last_v"] if b["last_v"] is None else b["last_v"],
        "max_gap": _least(_least(a["max_gap"], b["max_gap"], max), gap, max), "change": a["change"] + b["change"] + over,
    }


def _partial_states(value_type: str):
    v = pa.int64() if value_type == "bigint" else pa.float64()
    kinds = [v if "{v}" in f else pa.int64() for f in _STATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: dict | None = None  # the state of the last run, which may go on in the next batch
        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = schema or pa.schema([("k", batch.schema.field(0).type), *zip(_NAMES[1:], kinds[1:])])
            columns = _summaries(batch, value_type)
            runs = len(columns["k"])
            columns["part"] = pa.array(np.full(runs, part))
            states = pa.RecordBatch.from_arrays([columns[f].cast(t) for f, t in zip(_NAMES, schema.types)], schema=schema)
            first = states.slice(0, 1).to_pylist()[0]
            if held is not None:
                if held["k"] == first["k"]:
                    first = _stitch(held, first) | {"part": part}
                else:
                    yield pa.RecordBatch.from_pylist([held], schema=schema)
            if runs > 1:
                # of a batch only the ends are looked at one by one
                yield pa.RecordBatch.from_pylist([first], schema=schema)
                if runs > 2:
                    yield states.slice(1, runs - 2)
                held = states.slice(runs - 1).to_pylist()[0]
            else:
                held = first
        if held is not None:
            yield pa.RecordBatch.from_pylist([held], schema=schema)

    return run


def per_key_stats(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Statistics of every key, also those that depend on the order of a key's rows, without a task per key.

    The rows are range-partitioned on (key, order, value), with bounds from sampled quantiles, so that a key
    with many rows covers many partitions; a last component, the number of the input split, parts even rows
    that are alike. Each partition is sorted and reduced to one partial state per key it holds. What is shuffled
    again is these states, at most (keys + partitions), and the states of one key are stitched in the order of their
    partitions, which also gives the steps across partition borders.

    key: any orderable column, null keys form one group of their own. order: timestamp, date or integer.
    value: numeric; integers stay exact, others are taken as doubles, NaN as null.
    Result, one row per key: ``key``, n_rows (all rows), n_values (value not null), v_min, v_max, v_sum, v_mean,
    first_order and last_order (as order's type), first_value and last_value (of rows with order and value; of rows
    alike in order the least value is first, the greatest last), max_step (largest step of order between consecutive rows
    that have it; microseconds for timestamps, days for dates) and change (sum of the absolute steps of value over
    rows with order and value). What no row supports is null, n_rows and n_values are 0 or more, change is 0.
    Repeated rows count each time. An empty table gives an empty result; other columns are not read.
    """
    ship(df.sparkSession)
    o_type, v_type = df.schema[order].dataType, df.schema[value].dataType
    whole = isinstance(v_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    as_order = F.unix_micros(col(order)) if isinstance(o_type, T.TimestampType) else F.unix_date(col(order)) if isinstance(o_type, T.DateType) else col(order)
    v = col(value).cast("bigint") if whole else F.nanvl(col(value).cast("double"), F.lit(None).cast("double"))
    rows = df.select(col(key).alias("k"), as_order.cast("bigint").alias("o"), v.alias("v"), F.spark_partition_id().alias("split"))
    ranged = rows.repartitionByRange("k", "o", "v", "split").drop("split").sortWithinPartitions("k", "o", "v")
    kind = "bigint" if whole else "double"
    states = ranged.mapInArrow(_partial_states(kind), _STATE.format(k=df.schema[key].dataType.simpleString(), v=kind))
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stitched = (
        states.withColumn("gap", F.col("first_o") - F.last("last_o", ignorenulls=True).over(before))
        .withColumn("over", F.abs(F.col("first_v") - F.last("last_v", ignorenulls=True).over(before)))
        .groupBy("k")
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_values").alias("n_values"),
            F.min("v_min").alias("v_min"),
            F.max("v_max").alias("v_max"),
            F.when(F.sum("n_values") > 0, F.sum("v_sum")).alias("v_sum"),
            F.min("first_o").alias("first_o"),
            F.max("last_o").alias("last_o"),
            F.min_by("first_v", F.when(F.col("first_v").isNotNull(), F.col("part"))).alias("first_value"),
            F.max_by("last_v", F.when(F.col("last_v").isNotNull(), F.col("part"))).alias("last_value"),
            F.max(F.greatest("max_gap", "gap")).alias("max_step"),
            (F.sum("change") + F.coalesce(F.sum("over"), F.lit(0))).alias("change"),
        )
    )

    def back(name: str):
        if isinstance(o_type, T.TimestampType):
            return F.timestamp_micros(name)
        return F.date_from_unix_date(F.col(name).cast("int")) if isinstance(o_type, T.DateType) else F.col(name).cast(o_type)

    return stitched.select(
        F.col("k").alias(key), "n_rows", "n_values", "v_min", "v_max", "v_sum", (F.col("v_sum") / F.col("n_values")).alias("v_mean"),
        back("first_o").alias("first_order"), back("last_o").alias("last_order"), "first_value", "last_value", "max_step", "change",
    )


def heavy_keys(df: DataFrame, key: str, order: str, value: str, share: float) -> DataFrame:
    """The keys, null left out, that hold at least ``share`` of all rows: (key, n_rows, share), from ``per_key_stats``."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    stats = per_key_stats(df, key, order, value).where(col(key).isNotNull())
    return stats.select(col(key), "n_rows", (F.col("n_rows") / total).alias("share")).where(F.col("share") >= share)
