"""Items into containers of fixed capacity by bulk-synchronous best fit."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.session import Spool, col, ship

#: Rows that the driver sends to the executors by broadcast, a few numbers each; beyond it they are joined by shuffling.
MOST_BROADCAST = 200_000
#: A token is a maximal run of word characters or of other characters that are not blank (the WordPunct tokenizer).
WORD_PUNCT = r"\w+|[^\w\s]+"
_SWEPT = "what string, part bigint, place bigint, size bigint, item bigint, bin bigint, gap bigint"


def word_punct_count(text: Column) -> Column:
    """The number of WordPunct tokens of a text; 0 of null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PUNCT)), F.lit(0)).cast("bigint")


# Fixed value: how byte-level BPE of 50 257 ids divides a text before merging.
BYTE_BPE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=1)
def _encoding(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def vocabulary_count(df: DataFrame, text: str, vocabulary: str, into: str = "tokens", pattern: str = BYTE_BPE) -> DataFrame:
    """df with ``into``, the number of tokens of text (0 of null) by a file of ranks of the ``tiktoken`` library; executors read the path.

    The strings of special tokens count as ordinary text. Texts are counted one by one, in whole.
    """
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    at = df.columns.index(text)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoding(vocabulary, pattern)
        for batch in batches:
            counts = [len(model.encode_ordinary(x.as_py() or "")) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, "tokens"])

    schema = T.StructType([*plain.schema.fields, T.StructField("tokens", T.LongType())])
    return plain.mapInArrow(run, schema).toDF(*df.columns, into)


def _bundles(capacity: int):
    """Numbers the items of a partition; those of at most 1/64 of the capacity are joined to items of up to 1/32 of it."""
    small = capacity // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        item, bundle, filled = 0, -1, 0
        for batch in batches:
            numbers = []
            for size in batch.column(2).to_pylist():
                if size <= small and size:
                    if bundle < 0 or filled + size > 2 * small:
                        bundle, filled, item = item, 0, item + 1
                    filled += size
                    numbers.append(base + bundle)
                else:
                    numbers.append(base + item)
                    item += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, "item"])

    return run


def _brackets(size: np.ndarray, is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of partners in a sequence sorted by size, items first: each gap, from the smallest on, takes the greatest item before it that is free.

    That is the matching of brackets, an item opening and a gap closing one.
    """
    depth = np.cumsum(np.where(is_gap, -1, 1))
    # the depth of an item after it opens, and of a gap before it closes; a bracket's partner is the next one at its level
    level = np.where(is_gap, depth + 1, depth)
    order = np.lexsort((np.arange(len(size)), level))
    a, b = order[:-1], order[1:]
    pair = (level[a] == level[b]) & ~is_gap[a] & is_gap[b]
    return a[pair], b[pair]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches the items and gaps of one sorted partition, over again with what is left of the matched gaps until no item fits.

    What finds no partner goes out with its rank, gaps from the smallest, items from the greatest, since in this
    order partners in other partitions are found; matched containers go out with the rest of their gap.
    """
    part = TaskContext.get().partitionId()
    columns = [[], [], []]
    for batch in batches:
        for i, c in enumerate(columns):
            c.append(batch.column(i).to_numpy())
    if not columns[0]:
        return
    size, kind, number = (np.concatenate(c) for c in columns)
    is_gap, used = kind == 1, np.zeros(len(size), bool)
    pairs: list[tuple[np.ndarray, ...]] = []
    while True:
        items, gaps = _brackets(size, is_gap)
        if not len(items):
            break
        pairs.append((size[items], number[items], number[gaps]))
        size = size.copy()
        size[gaps] -= size[items]
        used[gaps] = True
        keep = np.ones(len(size), bool)
        keep[items] = False
        size, is_gap, number, used = size[keep], is_gap[keep], number[keep], used[keep]
        order = np.lexsort((number, is_gap, size))
        size, is_gap, number, used = size[order], is_gap[order], number[order], used[order]
    met = [np.concatenate(c) for c in zip(*pairs)] or [np.zeros(0, np.int64)] * 3
    lone_gaps, kept, lone_items = np.flatnonzero(is_gap & ~used), np.flatnonzero(used), np.flatnonzero(~is_gap)[::-1]
    none = lambda n: pa.nulls(n, pa.int64())
    for what, n, place, s, i, bin_, gap in (
        ("pair", len(met[0]), None, met[0], met[1], met[2], None),
        ("kept", len(kept), None, None, None, number[kept], size[kept]),
        ("gap", len(lone_gaps), np.arange(len(lone_gaps)), None, None, number[lone_gaps], size[lone_gaps]),
        ("item", len(lone_items), np.arange(len(lone_items)), size[lone_items], number[lone_items], None, None),
    ):
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([what] * n), pa.array(np.full(n, part)), *(none(n) if x is None else pa.array(x.astype(np.int64)) for x in (place, s, i, bin_, gap))], names=[f.split()[0] for f in _SWEPT.split(", ")]
            )


def _across(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Partners across partitions: (item partition, first rank, gap partition, first rank, number) of (partition, free items, free gaps), in order."""
    stack: list[list[int]] = []
    out = []
    for part, items, gaps in sorted(left):
        at = 0
        while stack and at < gaps:
            p, rank, n = stack[-1]
            m = min(n, gaps - at)
            out.append((p, rank, part, at, m))
            at += m
            stack[-1] = [p, rank + m, n - m]
            if n == m:
                stack.pop()
        if items:
            stack.append([part, 0, items])
    return out


def pack(df: DataFrame, row: str, size: Column, capacity: int, rows_per_sweep: int = 200_000, spool: Spool | None = None) -> DataFrame:
    """row, piece, piece_size, container: every row's items in containers of at most ``capacity``.

    A row whose size is over the capacity is divided, it alone: into full pieces, each a container, and a rest that is packed with
    the other items; piece counts from 0. A size of 0 or null gives one piece of size 0 without a container (null), a negative
    size counts as 0. Repeated rows and null rows are packed each for itself. An empty table gives no rows.

    Rounds of bulk-synchronous best fit: the free items and the gaps of the open containers are range-partitioned by
    size and sorted; a sweep over each partition gives every gap the greatest free item before it, so that no two seek the same, and
    goes on with the rest of the gaps while items of the partition fit; the items and gaps left over are matched across partitions by their ranks, for which the driver sees a few numbers per
    partition (some 100 bytes for each ``rows_per_sweep`` rows); there are as many partitions as give ``rows_per_sweep`` rows to each. Containers matched then have smaller gaps, and the next round begins, until all items
    are placed. A round whose gaps match less than 1/64 of the free items opens as many containers as the free items need at least. Items of at most 1/64 of
    the capacity are first joined to bundles of at most 1/32, in order of input, so a container holds some 64 of them at most, and takes as many rounds, however small the items are.
    """
    if capacity < 16:
        raise ValueError("a capacity below 16 is not supported")
    spark = df.sparkSession
    spool = spool or Spool(spark)
    few = lambda d, rows: F.broadcast(d) if rows <= MOST_BROADCAST else d
    sized = df.select(col(row).alias("row"), F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
    full = F.floor((F.col("size") - 1) / capacity).cast("bigint")
    pieces = sized.select("row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(full, F.lit(0)))).alias("piece"), "size").select(
        "row", "piece", F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("bigint").alias("piece_size")
    )
    members, _ = spool.write(pieces.mapInArrow(_bundles(capacity), T.StructType([*pieces.schema.fields, T.StructField("item", T.LongType())])))
    items = members.where((F.col("piece_size") > 0) & (F.col("piece_size") < capacity)).groupBy("item").agg(F.sum("piece_size").alias("size"))
    total, large, left = items.agg(F.sum("size"), F.count_if(F.col("size") * 2 > capacity), F.count(F.lit(1))).first()
    free = items.select(F.col("size"), F.lit(0).alias("kind"), F.col("item").alias("number"))
    opened, open_gaps, fresh = 0, 0, max(math.ceil((total or 0) / capacity), large or 0)
    placed: list[DataFrame] = []
    while left:
        if fresh:
            free = free.unionByName(spark.range(opened, opened + fresh, 1, max(1, fresh // 1_000_000)).select(F.lit(capacity).cast("bigint").alias("size"), F.lit(1).alias("kind"), F.col("id").alias("number")))
            opened += fresh
        sweeps = max(1, math.ceil((left + open_gaps + fresh) / rows_per_sweep))
        ranged = free.repartitionByRange(sweeps, "size", "kind", "number").sortWithinPartitions("size", "kind", "number")
        swept, _ = spool.write(ranged.mapInArrow(_sweep, _SWEPT))
        counts = swept.groupBy("part").agg(F.count_if(F.col("what") == "item"), F.count_if(F.col("what") == "gap"), F.count_if(F.col("what") == "pair"), F.min(F.when(F.col("what") == "item", F.col("size"))), F.max("gap"), F.count_if(F.col("what") == "kept")).collect()
        spans = _across([tuple(c[:3]) for c in counts])
        pairs, kept = swept.where("what = 'pair'").select("item", "bin"), swept.where("what = 'kept'").select("bin", "gap")
        lone_items, lone_gaps = swept.where("what = 'item'").select("part", "place", "size", "item"), swept.where("what = 'gap'").select(F.col("part").alias("gap_part"), F.col("place").alias("gap_place"), "bin", "gap")
        if spans:
            # two rows per sweep at most
            across = few(spark.createDataFrame(spans, "ip bigint, ir bigint, gp bigint, gr bigint, m bigint"), len(spans))
            met, _ = spool.write(
                lone_items.join(across, (F.col("part") == F.col("ip")) & (F.col("place") >= F.col("ir")) & (F.col("place") < F.col("ir") + F.col("m")))
                .select("item", "size", F.col("gp").alias("gap_part"), (F.col("gr") + F.col("place") - F.col("ir")).alias("gap_place"))
                .join(lone_gaps, ["gap_part", "gap_place"])
                .select("item", "bin", (F.col("gap") - F.col("size")).alias("gap"))
            )
            # ranks are taken from the front, so what is left begins where the spans of a partition end
            used = {}
            for p, ir, gp, gr, m in spans:
                used[("i", p)], used[("g", gp)] = max(used.get(("i", p), 0), ir + m), max(used.get(("g", gp), 0), gr + m)
            taken = few(spark.createDataFrame([(k, p, n) for (k, p), n in used.items()], "k string, p bigint, n bigint"), len(used))
            beyond = lambda d, k, part, place: d.join(taken.where(F.col("k") == k), F.col(part) == F.col("p"), "left").where(F.col(place) >= F.coalesce("n", F.lit(0))).drop("k", "p", "n")
            lone_items, lone_gaps = beyond(lone_items, "i", "part", "place"), beyond(lone_gaps, "g", "gap_part", "gap_place")
            pairs, kept = pairs.unionByName(met.select("item", "bin")), kept.unionByName(met.select("bin", "gap"))
        crossed = sum(s[4] for s in spans)
        matched = crossed + sum(c[3] for c in counts)
        left_before, left = left, left - matched
        open_gaps = sum(c[2] + c[6] for c in counts)
        placed.append(pairs)
        least = min((c[4] for c in counts if c[4]), default=1)
        gaps = kept.unionByName(lone_gaps.select("bin", "gap")).where(F.col("gap") >= least)
        free = lone_items.select("size", F.lit(0).alias("kind"), F.col("item").alias("number")).unionByName(gaps.select(F.col("gap").alias("size"), F.lit(1).alias("kind"), F.col("bin").alias("number")))
        fresh = 0
        if left and (matched * 64 < left_before or max((c[5] or 0 for c in counts), default=0) < least):
            fresh = max(1, math.ceil(lone_items.agg(F.sum("size")).first()[0] / capacity))
    alone = members.where(F.col("piece_size") == capacity).select("row", "piece", "piece_size", (F.lit(1 << 61) + F.col("item")).alias("container"))
    nothing = members.where("piece_size = 0").select("row", "piece", "piece_size", F.lit(None).cast("bigint").alias("container"))
    out = alone.unionByName(nothing)
    if placed:
        homes = reduce(DataFrame.unionByName, placed)
        shared = members.where((F.col("piece_size") > 0) & (F.col("piece_size") < capacity)).join(homes.hint("merge"), "item")
        out = out.unionByName(shared.select("row", "piece", "piece_size", F.col("bin").alias("container")))
    return out.withColumnRenamed("row", row)
