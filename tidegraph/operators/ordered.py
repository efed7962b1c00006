"""Positions of rows within their keys, without a task per key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.session import Spool


def _number(key_at: int, weight_at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, count = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            k = batch.column(key_at)
            differs = pc.fill_null(pc.not_equal(k.slice(0, n - 1), k.slice(1)), True).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(differs) + 1])
            weight = np.ones(n, np.int64) if weight_at is None else batch.column(weight_at).to_numpy().astype(np.int64)
            upto = np.cumsum(weight)
            place = upto - weight - np.repeat(upto[starts] - weight[starts], np.diff(np.append(starts, n)))
            first = k[0].as_py()
            if first == last:
                place[: starts[1] if len(starts) > 1 else n] += count
            last, count = k[n - 1].as_py(), int(place[-1] + weight[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(place)], names=[*batch.schema.names, "part", "place"])

    return run


def positions(df: DataFrame, key: str, order: Sequence[str], spool: Spool, weight: str | None = None) -> tuple[DataFrame, str]:
    """df with ``pos``, a row's place (from 0) among the rows of its key in the given order, and the spooled table behind it.

    With ``weight``, a column of non-negative integers, it is the sum of the weights before the row instead.
    df holds no column named part, place or pos and no null key. The rows are range-partitioned on
    (key, order), numbered within the sorted partitions and written to the shared folder; the number of a
    key's rows in earlier partitions, of which there are at most (keys + partitions), is added afterwards. A heavy
    key thus covers many partitions; ``order`` should end in a unique column, else rows alike share a partition.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("part", T.LongType()), T.StructField("place", T.LongType())])
    ranged = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    numbered, path = spool.write(ranged.mapInArrow(_number(df.columns.index(key), df.columns.index(weight) if weight else None), schema))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    counts = numbered.groupBy(key, "part").agg(rows.alias("rows")).withColumn("ahead", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    # of the keys that cross a partition border, a row per partition; written, so that its size is known and decides on a broadcast
    split, _ = spool.write(counts.where("ahead > 0").select(F.col(key).alias("split_key"), F.col("part").alias("split_part"), "ahead"))
    joined = numbered.join(split, (F.col(key) == F.col("split_key")) & (F.col("part") == F.col("split_part")), "left")
    return joined.select(*df.columns, (F.col("place") + F.coalesce("ahead", F.lit(0))).alias("pos")), path
