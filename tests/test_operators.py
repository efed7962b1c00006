"""Data-processing operators against brute force, and their edge cases."""

from collections import defaultdict
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.operators.ordered import positions
from tidegraph.operators.regular_grid import regular_grid
from tidegraph.operators.rolling_totals import rolling_totals
from tidegraph.operators.skewed_keys import heavy_keys, per_key_stats
from tidegraph.operators import spikes
from tidegraph.operators.spikes import HALO, flag_readings, haar_details, spike_mask, stuck_mask
from tidegraph.plans import problems
from tidegraph.session import Spool

T0 = datetime(2022, 1, 1)
NO_MERGE = "spark.sql.adaptive.coalescePartitions.enabled"


@pytest.fixture
def many_partitions(spark):
    """Tiny shuffles keep all their partitions, so that keys do cross partition borders."""
    spark.conf.set(NO_MERGE, "false")
    yield
    spark.conf.unset(NO_MERGE)


# skewed keys --------------------------------------------------------------------------------------


def brute_stats(rows):
    by = defaultdict(list)
    for k, t, v in rows:
        by[k].append((t, v))
    out = {}
    for k, xs in by.items():
        ts = sorted(t for t, _ in xs if t is not None)
        vs = [v for _, v in xs if v is not None]
        both = sorted((t, v) for t, v in xs if t is not None and v is not None)
        us = lambda d: int(d.total_seconds() * 1_000_000)
        steps = [us(b - a) for a, b in zip(ts, ts[1:])]
        out[k] = (
            len(xs), len(vs), min(vs, default=None), max(vs, default=None), sum(vs) if vs else None, ts[0] if ts else None, ts[-1] if ts else None,
            both[0][1] if both else None, both[-1][1] if both else None, max(steps, default=None), sum(abs(b[1] - a[1]) for a, b in zip(both, both[1:])),
        )
    return out


def test_per_key_stats(spark, many_partitions):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(3000):
        k = "hot" if rng.random() < 0.6 else None if rng.random() < 0.1 else f"k{rng.integers(40)}"
        t = None if rng.random() < 0.05 else T0 + timedelta(seconds=int(rng.integers(2000)))
        rows.append((k, t, None if rng.random() < 0.1 else int(rng.integers(-50, 50))))
    rows += [("hot", T0, 7)] * 900 + [("dark", None, None)] * 3
    # names that the operator uses itself
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "id string, `a b.c` timestamp, part int, n_rows int, k int").repartition(7)
    got = {r[0]: (r.n_rows, r.n_values, r.v_min, r.v_max, r.v_sum, r.first_order, r.last_order, r.first_value, r.last_value, r.max_step, r.change) for r in per_key_stats(df, "id", "a b.c", "part").collect()}
    assert got == brute_stats(rows)
    heavy = heavy_keys(df, "id", "a b.c", "part", 0.5).collect()
    assert [(r["id"], r["n_rows"]) for r in heavy] == [("hot", got["hot"][0])]


def test_per_key_stats_of_doubles_days_and_nothing(spark):
    df = spark.createDataFrame([(1, date(2022, 1, 1), 1.5), (1, date(2022, 1, 4), float("nan")), (1, date(2022, 1, 4), -2.0)], "k int, d date, v double")
    r = per_key_stats(df, "k", "d", "v").first()
    assert (r.n_rows, r.n_values, r.v_min, r.v_max, r.v_sum, r.max_step, r.change, r.first_order) == (3, 2, -2.0, 1.5, -0.5, 3, 3.5, date(2022, 1, 1))
    assert per_key_stats(df.limit(0), "k", "d", "v").collect() == []
    assert heavy_keys(df.limit(0), "k", "d", "v", 0.1).collect() == []


def test_per_key_stats_of_many_keys(spark, many_partitions):
    """A long tail of keys with a row or two each, over batches of a few rows, beside one key with a third of all rows."""
    df = spark.range(60_000).selectExpr("case when id % 3 = 0 then -1 else id div 2 end k", "timestamp_micros(id % 977) o", "(id * 7919) % 101 v")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = per_key_stats(df, "k", "o", "v")
        want = df.groupBy("k").agg(F.count("v").alias("n_rows"), F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.sum("v").alias("v_sum"), F.min("o").alias("first_order"), F.max(F.struct("o", "v")).alias("last"))
        both = got.join(want.withColumnsRenamed({c: f"w_{c}" for c in want.columns if c != "k"}), "k", "full")
        same = " and ".join(f"{c} <=> w_{c}" for c in ("n_rows", "v_min", "v_max", "v_sum", "first_order")) + " and last_value <=> w_last.v and last_order <=> w_last.o"
        assert both.count() == df.select("k").distinct().count() and both.where(f"not ({same})").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_positions(spark, many_partitions):
    rows = [("a" if i % 3 else "b", int(x), i) for i, x in enumerate(np.random.default_rng(2).integers(50, size=2000))]
    df, _ = positions(spark.createDataFrame(rows, "k string, o int, u int").repartition(5), "k", ("o", "u"), Spool(spark))
    for k in "ab":
        got = [(r.o, r.u) for r in sorted((r for r in df.collect() if r.k == k), key=lambda r: r.pos)]
        assert got == sorted((o, u) for kk, o, u in rows if kk == k)
        assert sorted(r.pos for r in df.collect() if r.k == k) == list(range(len(got)))


# regular grid -------------------------------------------------------------------------------------


def test_grid_within_days(spark):
    at = lambda *m: [T0 + timedelta(minutes=x) for x in m]
    rows = [("a", t, v) for t, v in zip(at(1, 5, 31, 125, 1441), (1, 3, 5, 7, 9))] + [("a", at(31)[0], 6), ("b", T0, 1), (None, T0, 1), ("a", None, 1), ("a", T0, None)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "id string, ts timestamp, v int, slot string, n int")
    got = [tuple(r) for r in regular_grid(df, "id", "ts", "v", max_gap_s=3000).where("id = 'a'").orderBy("slot").collect()]
    s0 = 1640995200
    want = [("a", s0, 2, 2.0, 1, 3, 3, 3, "observed")]
    want += [("a", s0 + 600 * i, 0, None, None, None, None, 3, "carried") for i in (1, 2)]
    want += [("a", s0 + 1800, 2, 5.5, 5, 6, 6, 6, "observed")]
    want += [("a", s0 + 600 * i, 0, None, None, None, None, 6 if i <= 8 else None, "carried" if i <= 8 else "missing") for i in range(4, 12)]
    want += [("a", s0 + 7200, 1, 7.0, 7, 7, 7, 7, "observed"), ("a", s0 + 86400, 1, 9.0, 9, 9, 9, 9, "observed")]
    assert got == want
    assert regular_grid(df.limit(0), "id", "ts", "v").collect() == []


@pytest.mark.parametrize("kind, v", [("int", [-(2**31), 2**31 - 1, -1]), ("bigint", [-(2**62), 2**62, -1]), ("double", [-0.5, 1e300, -2.0]), ("string", ["a", "c", "b"])])
def test_the_last_value_of_a_period(spark, kind, v):
    """Of readings at one instant the greatest, for values of any type."""
    rows = [("a", T0, v[1]), ("a", T0 + timedelta(microseconds=599_999_999), v[0]), ("a", T0 + timedelta(microseconds=599_999_999), v[2]), ("a", T0 + timedelta(seconds=600), v[1])]
    df = spark.createDataFrame(rows, f"id string, ts timestamp, v {kind}")
    df = df if kind != "string" else df.withColumn("v", F.ascii("v").cast("smallint"))
    want = [v[2], v[1]] if kind != "string" else [98, 99]
    if kind == "double":
        want[0] = v[0]
    assert [r.v_last for r in regular_grid(df, "id", "ts", "v").orderBy("slot").collect()] == want


def test_grid_over_a_whole_life(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{i % 3}", T0 - timedelta(days=3) + timedelta(seconds=int(x)), i) for i, x in enumerate(rng.integers(6 * 86400, size=150))]
    got = regular_grid(spark.createDataFrame(rows, "id string, ts timestamp, v int"), "id", "ts", "v", max_gap_s=7200, whole_life=True).collect()
    for s in ("s0", "s1", "s2"):
        last, readings = None, defaultdict(list)
        for k, t, v in rows:
            if k == s:
                e = int((t - datetime(1970, 1, 1)).total_seconds())
                readings[e // 600 * 600].append((e, v))
        want = {}
        for slot in range(min(readings), max(readings) + 1, 600):
            if slot in readings:
                last = (slot, max(readings[slot])[1])
            near = slot - last[0] <= 7200
            want[slot] = (len(readings.get(slot, ())), last[1] if near else None, "observed" if slot in readings else "carried" if near else "missing")
        assert {r.slot: (r.n, r.filled, r.status) for r in got if r.id == s} == want
    with pytest.raises(ValueError):
        regular_grid(spark.createDataFrame(rows, "id string, ts timestamp, v int"), "id", "ts", "v", max_gap_s=10**6)


def test_series_crosses_midnight_and_sets_reset_clocks_apart(spark, tmp_path):
    at = [T0 + timedelta(minutes=x) for x in (1400, 1425, 1450, 3000)] + [datetime(1970, 1, 1, 0, 5), datetime(1970, 1, 1, 0, 25)]
    spark.createDataFrame([("a", t, i) for i, t in enumerate(at)], "id string, ts timestamp, v int").write.parquet(f"{tmp_path}/ts.parquet")
    got = {r.slot: (r.n, r.filled, r.status) for r in problems.p2_grid(spark, str(tmp_path)).collect()}
    s0 = 1640995200
    want = {0: (1, 4, "observed"), 600: (0, 4, "carried"), 1200: (1, 5, "observed")}
    seen = {140: 0, 142: 1, 145: 2, 300: 3}
    for i in range(140, 301):
        last = max(k for k in seen if k <= i)
        want[s0 + 600 * i] = (1, seen[i], "observed") if i in seen else (0, seen[last], "carried") if i - last <= 6 else (0, None, "missing")
    assert got == want


def test_life_has_every_period_of_a_long_silence(spark, tmp_path):
    """No silence divides p2_life: the decades after a reset clock and the years of a source that was off are all there, once each."""
    at = {"reset": [datetime(1970, 1, 1, 0, 5), T0, T0 + timedelta(minutes=25)], "off": [T0 - timedelta(days=800, minutes=7), T0], "on": [T0, T0 + timedelta(days=2)]}
    spark.createDataFrame([(k, t, i) for k, ts in at.items() for i, t in enumerate(ts)], "id string, ts timestamp, v int").write.parquet(f"{tmp_path}/ts.parquet")
    slot = lambda t: int((t - datetime(1970, 1, 1)).total_seconds()) // 600 * 600
    ends = {k: (slot(ts[0]), slot(ts[-1])) for k, ts in at.items()}
    got = problems.p2_life(spark, str(tmp_path)).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("kinds"), F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    assert {r.id: (r.n, r.kinds, r.lo, r.hi) for r in got.collect()} == {k: (n := (hi - lo) // 600 + 1, n, lo, hi) for k, (lo, hi) in ends.items()}
    sums = {(r.id, r.status): (r.periods, r.n, r.filled_sum) for r in problems.p2_life_sums(spark, str(tmp_path)).collect()}
    assert {k: sums["reset", k] for k in ("observed", "carried")} == {"observed": (3, 3, 3), "carried": (7, 0, 1)}
    assert {k: sums["off", k][0] for k in ("observed", "carried", "missing")} == {"observed": 2, "carried": 6, "missing": (ends["off"][1] - ends["off"][0]) // 600 - 7}


@pytest.mark.parametrize("silence, gap", [(None, 7200), (None, 86400), (None, 300), (86400, 86400), (3 * 86400, 3600)])
def test_lives_with_silences_of_days(spark, many_partitions, silence, gap):
    """Silences of none to many days, ends just before and after midnight."""
    rng = np.random.default_rng(5)
    rows = [(f"s{i % 4}", T0 + timedelta(days=int(rng.choice([-90, -9, -7, -6, -2, -1, 0, 1, 40])), seconds=int(rng.choice([0, 60, 43200, 82800, 86399]))), i) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, ts timestamp, v int")
    got = regular_grid(df, "id", "ts", "v", max_gap_s=gap, whole_life=True, max_silence_s=silence).collect()
    want = []
    for s in {k for k, _, _ in rows}:
        readings = defaultdict(list)
        for k, t, v in rows:
            if k == s:
                e = int((t - datetime(1970, 1, 1)).total_seconds())
                readings[e // 600 * 600].append((e, v))
        slots = sorted(readings)
        for a, b in zip(slots, [*slots[1:], None]):
            want.append((s, a, len(readings[a]), max(readings[a])[1], "observed"))
            if b is not None and (silence is None or b - a <= silence):
                want += [(s, x, 0, max(readings[a])[1] if x - a <= gap else None, "carried" if x - a <= gap else "missing") for x in range(a + 600, b, 600)]
    assert sorted((r.id, r.slot, r.n, r.filled, r.status) for r in got) == sorted(want)


# rolling totals -----------------------------------------------------------------------------------


def test_rolling_totals(spark):
    rng = np.random.default_rng(4)
    rows = [(f"e{i % 2}", None if i % 17 == 0 else "x", date(2022, 1, 1) + timedelta(days=int(d)), None if i % 11 == 0 else float(v)) for i, (d, v) in enumerate(zip(rng.integers(120, size=90), rng.integers(-9, 99, size=90)))]
    rows += rows[:5] + [("e0", "x", None, 1.0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "site string, t string, d date, v double, total double, n int".replace("total double", "total int"))
    got = {(r.site, r.day): (r.total_3d, r.n_3d, r.mean_3d, r.total_30d) for r in rolling_totals(df, ["site", "t"], "d", "v", (3, 30)).collect()}
    want = {}
    for e in ("e0", "e1"):
        own = [(d, v) for s, t, d, v in rows if s == e and t and d]
        day = min(d for d, _ in own)
        while day <= max(d for d, _ in own):
            near = lambda p: [v for d, v in own if v is not None and 0 <= (day - d).days < p]  # noqa: B023, E731
            three = near(3)
            want[e, day] = (sum(three), len(three), sum(three) / len(three) if three else None, sum(near(30)))
            day += timedelta(days=1)
    assert got == want
    quarters = {(r.site, r.day) for r in rolling_totals(df, ["site", "t"], "d", "v", (3,), per_quarter=True).collect()}
    assert ("e0", date(2022, 1, 1)) in quarters and ("e0", date(2022, 4, 1)) in quarters
    assert rolling_totals(df.limit(0), ["site", "t"], "d", "v").collect() == []
    with pytest.raises(ValueError):
        rolling_totals(df, ["site"], "d", "v", ())


# spikes -------------------------------------------------------------------------------------------


def noise_scale(x):
    """The noise of a whole series by brute force."""
    d = np.abs(np.diff(np.asarray(x, float))) / np.sqrt(2)
    if not (d > 0).any():
        return 0.0
    step = d[d > 0].min()
    return max(np.median(d) / 0.6745, min(np.sqrt(np.mean(np.minimum(d, 4 * step) ** 2)), step))


def test_masks():
    rng = np.random.default_rng(5)
    x = np.round(1000 + 50 * np.sin(np.arange(3000) / 200) + rng.normal(0, 5, 3000))
    x[1500:] += 400  # a lasting change
    assert not spike_mask(x, noise_scale(x)).any()
    planted = {100: 1, 700: 2, 1300: 3, 1495: 2, 1503: 1, 2200: 3, 2208: 1}
    for at, n in planted.items():
        x[at : at + n] += 120 * (1 if at % 2 else -1)
    want = {at + i for at, n in planted.items() for i in range(n)}
    assert set(np.flatnonzero(spike_mask(x, noise_scale(x)))) == want
    assert 4 < noise_scale(x) < 6
    x[2500:2504] += 500  # four in a row are no spike
    assert set(np.flatnonzero(spike_mask(x, noise_scale(x)))) == want
    assert stuck_mask(np.array([1.0] * 9 + [2.0] * 10)).tolist() == [False] * 9 + [True] * 10
    assert haar_details(np.array([0.0, 0, 4, 0, 0]), 1).round(6).tolist() == [0, 0, round(4 / np.sqrt(2), 6), round(-4 / np.sqrt(2), 6), 0]
    for short in ([], [1.0], [1.0, 9.0], [1.0, 1.0, 500.0, 1.0]):
        assert spike_mask(np.array(short), 1.0).sum() == 0
    x = np.zeros(60)
    x[[20, 21, 22, 40]] = 90, 80, -70, 50  # spikes of opposite sign side by side
    x[50:] = 30  # a change that lasts
    assert np.flatnonzero(spike_mask(x, 1.0)).tolist() == [20, 21, 22, 40]


def test_details_decide(monkeypatch):
    x = np.random.default_rng(8).normal(0, 1, 200)
    x[90:92] += 30
    assert np.flatnonzero(spike_mask(x, 1.0)).tolist() == [90, 91]
    details = spikes._spike_details
    monkeypatch.setattr(spikes, "_spike_details", lambda y, longest: (details(y, longest)[0] * 0, details(y, longest)[1]))
    assert not spike_mask(x, 1.0).any()
    monkeypatch.setattr(spikes, "haar_details", lambda y, level: np.ones(len(y)))
    assert not stuck_mask(np.ones(50)).any()


def spiky_rows():
    rng = np.random.default_rng(6)
    rows, faulty, row = [], {}, 0
    for s, n in (("big", 2500), ("small", 90)):
        v = np.round(500 + rng.normal(0, 4, n)).astype(int)
        v[40] += 100
        v[60:72] = 500
        v[80] = 5000
        if s == "big":
            v[HALO * 3 : HALO * 3 + 2] -= 90
            v[1020:1036] = 497
        kinds = {40: "spike", **dict.fromkeys(range(60, 72), "stuck"), 80: "impossible"} | ({HALO * 3: "spike", HALO * 3 + 1: "spike", **dict.fromkeys(range(1020, 1036), "stuck")} if s == "big" else {})
        # runs may be longer by chance
        for i in range(n):
            faulty[row] = kinds.get(i) or ("stuck" if (v[i] == 500 and (i in (59, 72))) or (s == "big" and v[i] == 497 and i in (1019, 1036)) else None)
            rows.append((row, s, T0 + timedelta(seconds=i * 7), int(v[i])))
            row += 1
    return rows, {k: v for k, v in faulty.items() if v}


@pytest.mark.parametrize("chunk", [8192, 128])
def test_flag_readings(spark, many_partitions, chunk):
    rows, faulty = spiky_rows()
    more = [rows[3], (None, "big", T0, 1), (10**6, None, T0, 1), (10**6 + 1, "big", None, 1), (10**6 + 2, "big", T0, None)]
    order = np.random.default_rng(7).permutation(len(rows))
    df = spark.createDataFrame([(*rows[i], "x", 0) for i in order] + [(*r, "x", 0) for r in more], "dp long, id string, t timestamp, v long, chunk string, pos int")
    bounds = spark.createDataFrame([("big", 0, 1000), ("big", -5, 2000), ("small", None, 1000), (None, 1, 2)], "id string, lo int, hi int")
    got = flag_readings(df, bounds, "id", "t", "v", "dp", "lo", "hi", chunk=chunk).collect()
    assert {r["row"]: "impossible" if r.impossible else "stuck" if r.stuck else "spike" for r in got} == faulty
    assert len(got) == len(faulty)


@pytest.mark.parametrize("lo, hi", [(0, None), (None, 1000)])
def test_a_null_bound_leaves_the_noise_as_it_is(spark, lo, hi):
    rng = np.random.default_rng(10)
    v = np.round(500 + rng.normal(0, 4, 600)).astype(int)
    v[100:500:2] = 10**6 if lo is None else -(10**6)  # impossible on the side that is bounded
    v[300:320] = v[0]
    v[40] += 100
    df = spark.createDataFrame([(i, "a", T0 + timedelta(seconds=i), int(x)) for i, x in enumerate(v)], "dp long, id string, t timestamp, v long")
    bounds = spark.createDataFrame([("a", lo, hi)], "id string, lo int, hi int")
    got = flag_readings(df, bounds, "id", "t", "v", "dp", "lo", "hi").collect()
    assert {r["row"] for r in got if r.spike} == {40}
    assert {r["row"] for r in got if r.impossible} == set(np.flatnonzero(abs(v) == 10**6))


@pytest.mark.parametrize("copies", [1, 700])
def test_flags_across_partition_borders(spark, many_partitions, copies):
    """Partitions of a few readings, and one reading that is repeated in several partitions, change no verdict."""
    rng = np.random.default_rng(11)
    v = np.round(900 + np.cumsum(rng.normal(0, 1, 260)) + rng.normal(0, 3, 260)).astype(int)
    for at, n in ((30, 1), (77, 3), (131, 2), (200, 2), (215, 1)):
        v[at : at + n] += 90
    v[160:175] = v[160]
    limits = spark.createDataFrame([("a", 0, 5000)], "id string, lo int, hi int")
    want = set(np.flatnonzero(stuck_mask(v) | spike_mask(v, noise_scale(v))))
    rows = [(i, "a", T0 + timedelta(seconds=i), int(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows + [rows[131]] * copies, "dp long, id string, t timestamp, v long").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = flag_readings(df, limits, "id", "t", "v", "dp", "lo", "hi", chunk=64).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {30, 77, 78, 79, 131, 132, 200, 201, 215} | set(range(160, 175)) <= want
    assert {r["row"] for r in got} == want and len(got) == len(want)


def test_noise_adds_up_from_blocks(spark, many_partitions):
    rng = np.random.default_rng(12)
    series = {"fine": rng.normal(0, 20, 3000), "coarse": np.round(rng.normal(0, 0.3, 900)) * 10, "flat": np.ones(40), "one": np.ones(1)}
    rows = [(i, k, T0 + timedelta(seconds=i), float(x)) for k, v in series.items() for i, x in enumerate(v)]
    spool = Spool(spark)
    flag_readings(spark.createDataFrame(rows, "dp long, id string, t timestamp, v double"), spark.createDataFrame([], "id string, lo int, hi int"), "id", "t", "v", "dp", "lo", "hi", chunk=200, spool=spool)
    got = {r.k: r.scale for r in spark.read.parquet(f"{spool.root}/1").collect()}
    assert got.keys() >= {"fine", "coarse", "flat"} and got["flat"] == 0
    for k in ("fine", "coarse"):
        assert abs(got[k] - noise_scale(series[k])) <= noise_scale(series[k]) * 2**-7


def test_flag_nothing(spark):
    df = spark.createDataFrame([], "dp long, id string, t timestamp, v long")
    bounds = spark.createDataFrame([], "id string, lo int, hi int")
    assert flag_readings(df, bounds, "id", "t", "v", "dp", "lo", "hi").collect() == []
    one = spark.createDataFrame([(1, "a", T0, 5), (2, "a", T0, 5)], "dp long, id string, t timestamp, v long")
    assert flag_readings(one, bounds, "id", "t", "v", "dp", "lo", "hi").collect() == []
