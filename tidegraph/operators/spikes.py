"""Spikes, stuck values and impossible readings, judged per source by a wavelet decomposition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.session import Spool, col, ship

#: Readings on either side that a verdict may depend on: several times the widest filter, and the longest spike.
HALO = 64
#: Readings of the longer block of an unbalanced Haar wavelet, by level.
LEVELS = (2, 4)
#: Cells per doubling in which absolute details are counted.
CELLS = 128


def haar_details(x: np.ndarray, level: int) -> np.ndarray:
    """Undecimated Haar details at 2 ** level: mean of the block from i on less mean of the block before i, orthonormal."""
    b = 2 ** (level - 1)
    padded = np.concatenate([np.full(b, x[0]), x, np.full(b - 1, x[-1])]).astype(float)
    sums = np.concatenate([[0.0], np.cumsum(padded - padded[0])])
    i = np.arange(len(x)) + b
    return (sums[i + b] - 2 * sums[i] + sums[i - b]) / np.sqrt(2 * b)


def _spike_details(y: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each reading the height and width of the spike that begins there; height 0 where none does.

    The details are those of undecimated unbalanced Haar wavelets: a block of one reading against the mean of the readings
    before the spike, and against that of the readings behind it, scaled to a reading's own noise, at LEVELS of
    block length. The height of a run at a level is the least of its details, of which the two of a reading must agree in
    sign (a lasting change has one alone); that of the run is the greater of its levels', since a longer block may reach into a change close by.
    The first-level details at both ends of the run must be half its height and cancel: what is left of their sum is the
    change from the reading before to the one behind. A run may hold spikes of opposite sign side by side, each of at most ``longest`` readings.
    """
    n, most, pad = len(y), 2 * longest, max(LEVELS)
    padded = np.concatenate([np.full(pad, np.nan), y - y[0], np.full(pad + most, np.nan)])
    there = ~np.isnan(padded)
    sums, counts = (np.concatenate([[0.0], np.cumsum(a)]) for a in (np.where(there, padded, 0.0), there))

    def mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = counts[b] - counts[a]
        return np.where(k > 0, (sums[b] - sums[a]) / np.maximum(k, 1), np.nan)

    i = np.arange(n) + pad
    last = padded[i - 1]
    befores = [mean(i - size, i) for size in LEVELS]
    height, width = np.zeros(n), np.zeros(n, int)
    for w in range(1, most + 1):
        behind = padded[i + w]
        left = np.abs(behind - last)
        edge = np.fmin(np.abs(padded[i] - last), np.abs(padded[i + w - 1] - behind))
        for size, before in zip(LEVELS, befores):
            after = mean(i + w, i + w + size)
            # at an end of the series one level stands for both
            up, down = np.where(np.isnan(before), after, before), np.where(np.isnan(after), before, after)
            least, fits = np.full(n, np.inf), np.ones(n, bool)
            run, sign = np.zeros(n, int), np.zeros(n)
            for r in range(w):
                rise, fall = padded[i + r] - up, padded[i + r] - down
                run = np.where(np.sign(rise) == sign, run + 1, 1)
                sign = np.sign(rise)
                fits &= (run <= longest) & (sign == np.sign(fall))
                least = np.minimum(least, np.minimum(np.abs(rise), np.abs(fall)))
            fits &= ~np.isnan(least) & ~(left > least / 2) & ~(edge < least / 2)
            better = fits & (least > height)
            height, width = np.where(better, least, height), np.where(better, w, width)
    return height, width


def spike_mask(x: np.ndarray, scale: float, limit: float = 8.0, longest: int = 3) -> np.ndarray:
    """Runs of at most ``longest`` readings that leave the level by over limit x scale and after which it returns.

    Readings are spikes where their wavelet details (``_spike_details``), scaled by the noise, exceed the limit. The details of
    a spike reach into its neighbours', so the greatest within its surroundings are taken out of the series first, and what is left is
    decomposed again, until no detail exceeds the limit.
    """
    spiky = np.zeros(len(x), bool)
    place, y = np.arange(len(x)), x.astype(float)
    reach = max(LEVELS) + 2 * longest
    while len(y) >= 5:
        height, width = _spike_details(y, longest)
        if height.max() <= limit * max(scale, 1e-12):
            break
        around = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(reach), height, np.zeros(reach)]), 2 * reach + 1).max(axis=1)
        taken, free = np.zeros(len(y), bool), 0
        for a in np.flatnonzero((height > limit * max(scale, 1e-12)) & (height >= around)):
            if a >= free:
                taken[a : a + width[a]] = True
                free = a + reach
        spiky[place[taken]] = True
        place, y = place[~taken], y[~taken]
    return spiky


def stuck_mask(x: np.ndarray, least: int = 10) -> np.ndarray:
    """Members of runs of at least ``least`` readings between which the first-level details are zero."""
    if not len(x):
        return np.zeros(0, bool)
    starts = np.flatnonzero(np.concatenate([[True], haar_details(x, 1)[1:] != 0]))
    sizes = np.diff(np.append(starts, len(x)))
    return np.repeat(sizes >= least, sizes)


# blocks -------------------------------------------------------------------------------------------

_BLOCK = "k {k}, part bigint, first boolean, last boolean, n bigint, ahead bigint, v binary, row binary, cell array<int>, rows array<bigint>, least array<double>, most array<double>, edge struct<t0:bigint,r0:bigint,t1:bigint,r1:bigint,n:bigint,head:array<double>,tail:array<double>>"


class _Run:
    """The readings of one source in one partition, of which blocks are cut off at the front."""

    def __init__(self, key: object, outer: bool) -> None:
        self.key, self.outer = key, outer  # outer: the partition begins with this source
        self.v, self.row, self.possible = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)
        self.normal = np.zeros(0)  # the last possible value before the next block
        self.done, self.cut, self.blocks = 0, 0, 0  # readings behind which the next block begins, readings cut off, blocks
        self.first_id = self.last_id = None
        self.head = np.zeros(0)

    def add(self, t: np.ndarray, row: np.ndarray, v: np.ndarray, possible: np.ndarray) -> None:
        same = np.concatenate([[(int(t[0]), int(row[0])) == self.last_id], (t[1:] == t[:-1]) & (row[1:] == row[:-1])])
        if self.first_id is None:
            self.first_id = (int(t[0]), int(row[0]))
        self.last_id = (int(t[-1]), int(row[-1]))
        v, row, possible = v[~same], row[~same], possible[~same]
        if len(self.head) < HALO:
            self.head = np.concatenate([self.head, v[: HALO - len(self.head)]])
        self.v, self.row, self.possible = (np.concatenate(x) for x in ((self.v, v), (self.row, row), (self.possible, possible)))

    def blocks_of(self, chunk: int, end: bool, part: int, outer: bool) -> Iterator[dict]:
        """Blocks of ``chunk`` readings, each with HALO readings of either side as far as the partition holds them."""
        while len(self.v) - self.done > (0 if end else chunk + HALO):
            size = min(chunk, len(self.v) - self.done)
            if end and len(self.v) - self.done <= chunk + HALO:
                size = len(self.v) - self.done
            a, b = self.done, self.done + size
            first, last = self.blocks == 0, end and b == len(self.v)
            seen = self.v[max(0, a - HALO) : b + HALO]
            normal = np.concatenate([self.normal, self.v[a:b][self.possible[a:b]]])
            steps = np.abs(haar_details(normal, 1)[1:]) if len(normal) else normal
            self.normal = normal[-1:]
            cell = np.where(steps > 0, np.floor(np.log2(np.where(steps > 0, steps, 1)) * CELLS), -(1 << 30)).astype(np.int32)
            order = np.argsort(cell, kind="stable")
            cells, starts, rows = np.unique(cell[order], return_index=True, return_counts=True)
            made = {
                "k": self.key, "part": part, "first": first and self.outer, "last": last and outer, "n": size, "ahead": a - max(0, a - HALO), "v": seen.tobytes(), "row": self.row[a:b].tobytes(),
                "cell": cells, "rows": rows, "least": np.minimum.reduceat(steps[order], starts) if len(starts) else steps, "most": np.maximum.reduceat(steps[order], starts) if len(starts) else steps, "edge": None,
            }
            self.blocks += 1
            if last and (self.outer or outer):
                made["edge"] = {"t0": self.first_id[0], "r0": self.first_id[1], "t1": self.last_id[0], "r1": self.last_id[1], "n": self.cut + len(self.v), "head": self.head.tolist(), "tail": self.v[-HALO:].tolist()}
            yield made
            self.done = b
            spent = max(0, self.done - HALO)
            self.v, self.row, self.possible = self.v[spent:], self.row[spent:], self.possible[spent:]
            self.done, self.cut = self.done - spent, self.cut + spent


def _cut(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, made = TaskContext.get().partitionId(), None, []
        schema = None

        def full() -> Iterator[pa.RecordBatch]:
            nonlocal made
            yield pa.RecordBatch.from_pylist(made, schema=schema)
            made = []

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            k = batch.column(0)
            schema = schema or _schema(k.type)
            t, row, v, possible = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
            starts = np.concatenate([[0], np.flatnonzero(pc.not_equal(k.slice(0, n - 1), k.slice(1)).to_numpy(zero_copy_only=False)) + 1])
            keys = k.take(pa.array(starts)).to_pylist()
            for key, a, b in zip(keys, starts, np.append(starts[1:], n)):
                if held is None or key != held.key:
                    if held is not None:
                        made += held.blocks_of(chunk, True, part, False)
                    held = _Run(key, held is None)
                held.add(t[a:b], row[a:b], v[a:b], possible[a:b])
                made += held.blocks_of(chunk, False, part, False)
                if len(made) >= 64:
                    yield from full()
        if held is not None:
            made += held.blocks_of(chunk, True, part, True)
        if made:
            yield from full()

    return run


def _schema(key: pa.DataType) -> pa.Schema:
    many = lambda t: pa.list_(t)
    edge = pa.struct([("t0", pa.int64()), ("r0", pa.int64()), ("t1", pa.int64()), ("r1", pa.int64()), ("n", pa.int64()), ("head", many(pa.float64())), ("tail", many(pa.float64()))])
    return pa.schema(
        [("k", key), ("part", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), ("n", pa.int64()), ("ahead", pa.int64()), ("v", pa.binary()), ("row", pa.binary()),
         ("cell", many(pa.int32())), ("rows", many(pa.int64())), ("least", many(pa.float64())), ("most", many(pa.float64())), ("edge", edge)]
    )


def _judge(limit: float, longest: int, least: int):
    names = ("v", "row", "n", "ahead", "first", "last", "before", "after", "again", "scale", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for i in range(batch.num_rows):
                v, row, n, ahead, first, last, before, after, again, scale, lo, hi = (batch.column(j)[i].as_py() for j in range(len(names)))
                x, rows = np.frombuffer(v), np.frombuffer(row, np.int64)
                if again and first:  # the same reading ended the partition before
                    x, rows, n = np.delete(x, ahead), rows[1:], n - 1
                if first and before:
                    x, ahead = np.concatenate([before, x]), ahead + len(before)
                if last and after:
                    x = np.concatenate([x, after])
                impossible = ~((x >= (-np.inf if lo is None else lo)) & (x <= (np.inf if hi is None else hi)))
                stuck, spike = stuck_mask(x, least), np.zeros(len(x), bool)
                fit = np.flatnonzero(~impossible)
                spike[fit] = spike_mask(x[fit], scale, limit, longest)
                at = slice(ahead, ahead + n)
                faulty = (impossible | stuck | spike)[at]
                out.append((rows[faulty], *(a[at][faulty] for a in (impossible, stuck, spike))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["row", "impossible", "stuck", "spike"])

    return run


def _noise(blocks: DataFrame, steps: DataFrame) -> DataFrame:
    """(k, scale): the usual noise of each source as a standard deviation, from the absolute first-level details of its possible readings.

    The scale is their median / 0.6745. The details are counted by cells, CELLS per doubling, with the least and the greatest of
    each cell, so the counts of blocks add up and the median is exact where its cell holds one value, else within
    2^-8 of it. Of coarse sources, where over half the details are zero, the root mean square of the details cut at four steps stands in, one step at most.
    """
    counted = blocks.select("k", F.inline(F.arrays_zip("cell", "rows", "least", "most")))
    d = F.col("d")
    own = steps.select("k", F.when(d > 0, F.floor(F.log2(F.when(d > 0, d)) * CELLS)).otherwise(-(1 << 30)).cast("int").alias("cell"), F.lit(1).cast("bigint").alias("rows"), d.alias("least"), d.alias("most"))
    cells = counted.unionByName(own).groupBy("k", "cell").agg(F.sum("rows").alias("rows"), F.min("least").alias("least"), F.max("most").alias("most"))
    by = Window.partitionBy("k")
    upto = F.sum("rows").over(by.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    placed = cells.select("*", upto.alias("upto"), F.sum("rows").over(by).alias("all"), F.min(F.when(F.col("least") > 0, F.col("least"))).over(by).alias("step"))
    middle = (F.col("least") + F.col("most")) / 2
    holds = lambda rank: (F.col("upto") >= rank) & (F.col("upto") - F.col("rows") < rank)
    low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1
    cut = F.pow(F.least(middle, 4 * F.col("step")), F.lit(2)) * F.col("rows")
    found = placed.groupBy("k").agg(
        ((F.max(F.when(holds(low), middle)) + F.max(F.when(holds(high), middle))) / 2).alias("median"), F.first("step").alias("step"), F.sqrt(F.sum(cut) / F.first("all")).alias("coarse")
    )
    return found.select("k", F.coalesce(F.greatest(F.col("median") / 0.6745, F.least("coarse", "step")), F.lit(0.0)).alias("scale"))


def flag_readings(
    readings: DataFrame, bounds: DataFrame, key: str, ts: str, value: str, row: str, low: str, high: str, limit: float = 8.0, longest: int = 3, least: int = 10, chunk: int = 8192, spool: Spool | None = None
) -> DataFrame:
    """The faulty readings: (row, impossible, stuck, spike), one row per reading with at least one of the three.

    readings: each identified by key, ts and ``row`` (integer), repeated ones count once, with the least value; rows lacking key, ts,
    value or row, or of value NaN, are left out. bounds: one row per source with its lowest and highest possible value; a source without, or
    with a null bound, is not limited on that side; of repeated sources the tightest bounds hold. Sources run in order of (ts, row).

    The readings are shuffled once, range-partitioned on (key, ts, row) with sampled quantiles, so a source with a third of all rows is
    many partitions, and so are copies of one reading. Each sorted partition is cut into blocks of about ``chunk`` readings of one
    source with HALO readings of either neighbour, written to the shared folder a block a row, with the counts of its absolute
    first-level details. The counts give each source's noise scale (``_noise``). Then each block is decomposed where it
    lies and its details, scaled by the noise, are held against ``limit`` (``spike_mask``); runs of zero details are sticking (``least`` readings
    or more), bounds detect impossible readings, which the spikes' decomposition leaves out. Only the blocks at
    partition borders are shuffled again, two per partition at most, to meet the HALO readings of the next partitions. An
    empty table gives an empty result; other columns are not read.
    """
    if least > HALO or longest * 4 > HALO:
        raise ValueError("least and longest must fit into the halo")
    spark = readings.sparkSession
    ship(spark)
    spool = spool or Spool(spark)
    rows = (
        readings.select(col(key).alias("k"), F.unix_micros(col(ts).cast("timestamp")).alias("t"), col(row).cast("bigint").alias("row"), col(value).cast("double").alias("v"), F.spark_partition_id().alias("split"))
        .where("row is not null and k is not null and t is not null and v is not null and not isnan(v)")
    )
    kind = rows.schema["k"].dataType.simpleString()
    limits = bounds.where(col(key).isNotNull()).groupBy(col(key).alias("k")).agg(F.max(col(low).cast("double")).alias("lo"), F.min(col(high).cast("double")).alias("hi"))
    possible = lambda v: ~F.coalesce((F.col(v) < F.col("lo")) | (F.col(v) > F.col("hi")), F.lit(False))
    rows = rows.join(limits, "k", "left").withColumn("possible", possible("v")).drop("lo", "hi")
    sorted_rows = rows.repartitionByRange("k", "t", "row", "v", "split").sortWithinPartitions("k", "t", "row", "v").drop("split")
    blocks, _ = spool.write(sorted_rows.mapInArrow(_cut(chunk), _BLOCK.format(k=kind)))

    # what lies beyond a partition's ends; a partition may hold fewer than HALO readings of a source, so several are looked at
    over = Window.partitionBy("k").orderBy("part")
    ends = blocks.where("edge is not null").select("k", "part", "edge.*")
    again = F.coalesce((F.col("t0") == F.lag("t1").over(over)) & (F.col("r0") == F.lag("r1").over(over)), F.lit(False))
    ends = ends.withColumn("again", again)
    ends = ends.withColumn("head", F.when(F.col("again"), F.slice("head", 2, HALO)).otherwise(F.col("head"))).withColumn("tail", F.when(F.col("again") & (F.col("n") <= HALO), F.slice("tail", 2, HALO)).otherwise(F.col("tail")))
    near = lambda c, a, b: F.flatten(F.collect_list(c).over(over.rowsBetween(a, b)))
    ends = ends.select("k", "part", "again", "head", F.reverse(F.slice(F.reverse(near("tail", -HALO, -1)), 1, HALO)).alias("before"), F.slice(near("head", 1, HALO), 1, HALO).alias("after"))
    borders = ends.where(F.size("before") > 0).select("k", F.get("head", F.lit(0)).alias("v"), F.element_at("before", -1).alias("u")).join(limits, "k", "left")
    steps = borders.where(possible("u") & possible("v")).select("k", (F.abs(F.col("v") - F.col("u")) / 2**0.5).alias("d")).where("d is not null")
    scales, _ = spool.write(_noise(blocks, steps).join(limits, "k", "left"))
    own = ["k", "v", "row", "n", "ahead", "first", "last"]
    none: Column = F.lit(None).cast("array<double>")
    inner = blocks.where("not first and not last").select(*own, none.alias("before"), none.alias("after"), F.lit(False).alias("again"))
    outer = blocks.where("first or last").join(ends.drop("head"), ["k", "part"]).select(*own, "before", "after", "again")
    return inner.unionByName(outer).join(scales, "k").drop("k").mapInArrow(_judge(limit, longest, least), "row bigint, impossible boolean, stuck boolean, spike boolean")
