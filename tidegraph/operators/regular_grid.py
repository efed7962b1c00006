"""Irregular readings onto a regular grid of periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.session import col


def regular_grid(
    df: DataFrame, key: str, ts: str, value: str, period_s: int = 600, max_gap_s: int = 3600, segment_s: int = 86_400, whole_life: bool = False, max_silence_s: int | None = None
) -> DataFrame:
    """A row for every period of every source; empty periods are carried forward or marked as missing.

    Readings lacking key, ts or value are left out. They are aggregated by (key, segment, period) before the shuffle, so neither
    a source nor a single period with a third of all rows burdens one task. A sequence of periods per source
    and segment of ``segment_s`` seconds (a UTC day) is left-joined with the aggregates, partitioned by (key, segment, period);
    the window that carries forward runs by (key, segment). No task holds more of a source than a segment needs.

    whole_life=False: a source's periods go from the first to the last reading of each segment with readings.
    whole_life=True: from its first to its last reading of all; a value may then be carried into the next segment, for which
    the aggregates within max_gap_s before a segment's end are also given to the next. Segments without readings beyond that have
    only missing periods, which are made without a join. With max_silence_s, a source's life is divided where the periods of two
    successive readings are further apart: a clock reset to 1970 is a life of its own, in full, and the decades between two lives
    have no periods. Without it they have, 52 560 a year.

    Result: key, slot (start of the period, seconds since 1970-01-01 UTC), n (readings), v_mean, v_min, v_max,
    v_last (of the latest reading; of several at that instant the greatest), filled (v_last, or that of the last period
    with readings if that is at most max_gap_s earlier), status ('observed', 'carried', 'missing').
    Repeated rows count each time; no readings give no rows. Names of other columns of df do not matter.
    """
    if segment_s % period_s or max_gap_s > segment_s:
        raise ValueError("segment_s must be a multiple of period_s and at least max_gap_s")
    if max_silence_s is not None and (not whole_life or max_silence_s < segment_s):
        raise ValueError("max_silence_s must be at least segment_s and needs whole_life")
    us = F.unix_micros(col(ts))
    start = F.when(us.isNotNull(), ((us - F.pmod(us, F.lit(period_s * 1_000_000))) / 1_000_000).cast("bigint"))
    segment = lambda s: ((s - F.pmod(s, F.lit(segment_s))) / segment_s).cast("bigint")
    rows = df.where(col(key).isNotNull() & col(ts).isNotNull() & col(value).isNotNull()).select(col(key).alias("k"), start.alias("slot"), us.alias("us"), col(value).alias("v")).withColumn("seg", segment(F.col("slot")))
    kind = rows.schema["v"].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)) and period_s * 1_000_000 < 1 << 31:
        # time within the period and value in one whole number, which Spark aggregates by hashing; a pair it would have to sort
        latest = (F.col("us") - F.col("slot") * 1_000_000) * F.lit(1 << 32) + F.col("v").cast("bigint") + F.lit(1 << 31)
        last = (F.pmod("latest", F.lit(1 << 32)) - F.lit(1 << 31)).cast(kind)
    else:
        latest, last = F.struct("us", "v"), F.col("latest.v")
    buckets = (
        rows.groupBy("k", "seg", "slot")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("v_mean"), F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.max(latest).alias("latest"))
        .select("k", "seg", "slot", "n", "v_mean", "v_min", "v_max", last.alias("v_last"))
    )
    days = rows.groupBy("k", "seg").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    silent = None
    if whole_life:
        # a source has few segments with readings; those without any lie between them
        by_day = Window.partitionBy("k").orderBy("seg")
        days = days.withColumn("before", F.col("lo") - F.lag("hi").over(by_day)).withColumn("after", F.lead("lo").over(by_day) - F.col("hi")).withColumn("next", F.lead("seg").over(by_day))
        near_enough = lambda silence: F.col(silence).isNotNull() if max_silence_s is None else F.coalesce(F.col(silence) <= max_silence_s, F.lit(False))
        # a segment's periods begin max_gap_s before it: they are looked at for what they carry and left out
        reach = max_gap_s // period_s * period_s
        own = F.struct("seg", F.when(near_enough("before"), F.col("seg") * segment_s - reach).otherwise(F.col("lo")).alias("lo"), F.when(near_enough("after"), (F.col("seg") + 1) * segment_s - period_s).otherwise(F.col("hi")).alias("hi"))
        following = F.struct((F.col("seg") + 1).alias("seg"), ((F.col("seg") + 1) * segment_s - reach).alias("lo"), ((F.col("seg") + 2) * segment_s - period_s).alias("hi"))
        held = F.when(near_enough("after") & (F.col("next") > F.col("seg") + 1), F.array(own, following)).otherwise(F.array(own))
        bounds = days.select("k", F.explode(held).alias("held")).select("k", "held.*").repartition("k", "seg")
        late = F.col("slot") >= (F.col("seg") + 1) * segment_s - reach
        buckets = buckets.withColumn("seg", F.explode(F.when(late, F.array(F.col("seg"), F.col("seg") + 1)).otherwise(F.array("seg"))))
        # nothing is carried any further: the segments up to the next with readings are neither joined nor sorted. Decades of them are
        # spread by pieces over a number of partitions that is not lowered for the pieces being few
        piece_s = 30 * segment_s
        silent = days.where(near_enough("after") & (F.col("next") > F.col("seg") + 2)).select("k", ((F.col("seg") + 2) * segment_s).alias("lo"), (F.col("next") * segment_s - period_s).alias("hi"))
        silent = silent.select("k", "hi", F.explode(F.sequence("lo", "hi", F.lit(piece_s).cast("bigint"))).alias("lo")).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k", "lo")
        silent = silent.select("k", F.explode(F.sequence("lo", F.least("hi", F.col("lo") + (piece_s - period_s)), F.lit(period_s).cast("bigint"))).alias("slot"))
    else:
        bounds = days
    grid = bounds.select("k", "seg", F.explode(F.sequence("lo", "hi", F.lit(period_s).cast("bigint"))).alias("slot"))
    order = Window.partitionBy("k", "seg").orderBy("slot")
    joined = grid.join(buckets, ["k", "seg", "slot"], "left")
    seen = F.last(F.when(F.col("n").isNotNull(), F.struct("slot", "v_last")), ignorenulls=True).over(order)
    near = F.col("slot") - F.col("seen.slot") <= max_gap_s
    periods = (
        joined.withColumn("seen", seen)
        .where(F.col("slot") >= F.col("seg") * segment_s)
        .select(
            F.col("k").alias(key), "slot", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "v_mean", "v_min", "v_max", "v_last",
            F.when(near, F.col("seen.v_last")).alias("filled"),
            F.when(F.col("n").isNotNull(), "observed").when(near, "carried").otherwise("missing").alias("status"),
        )
    )
    if silent is None:
        return periods
    made = [F.col("k"), F.col("slot"), F.lit(0), *[F.lit(None)] * 5, F.lit("missing")]
    return periods.union(silent.select(*(c.cast(f.dataType).alias(f.name) for c, f in zip(made, periods.schema, strict=True))))
