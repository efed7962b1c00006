"""Percentiles against numpy, and merged counts within their bound."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import tidegraph.llm.percentiles as P
from tidegraph.llm.percentiles import cell_percentiles, count_cells, exact_percentiles, merge_cells

PS = [0.0, 0.05, 0.5, 0.95, 0.999, 1.0]


def discrete(xs, p):
    return sorted(xs)[max(int(np.ceil(round(p * len(xs), 9))), 1) - 1]


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(12)
    return {
        ("a", 1): [int(x) for x in rng.integers(-(2**40), 2**40, 800)], ("a", None): [5] * 50, ("b", 2): [2**62, 2**62 + 1, 2**62 + 2, -(2**62)], (None, None): [1],
        ("hot", 0): [int(x) for x in rng.normal(0, 9, 900)],
    }


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_whole_numbers(spark, groups, monkeypatch, broadcast):
    monkeypatch.setattr(P, "MOST_BROADCAST", broadcast)
    rows = [(*k, v, 0, 0) for k, vs in groups.items() for v in vs] + [("a", 1, None, 0, 0), ("empty", 1, None, 0, 0)]
    df = spark.createDataFrame(rows, "k string, p int, x long, v int, cell int")
    got = {(r[0], r[1], r[2]): (r.n, r.v) for r in exact_percentiles(df.withColumnRenamed("p", "g"), ["k", "g"], "x", PS, continuous=False).collect()}
    assert got == {(*k, p): (len(vs), discrete(vs, p)) for k, vs in groups.items() for p in PS}


def test_doubles_continuous(spark):
    rng = np.random.default_rng(13)
    xs = [float(x) for x in np.concatenate([rng.lognormal(0, 5, 500), -rng.lognormal(0, 5, 300), [0.0, 1e-300, 1e300, 7.0, 7.0]])]
    df = spark.createDataFrame([("a", x) for x in xs] + [("a", float("nan")), ("i", float("-inf")), ("i", 1.0), ("i", float("inf"))], "k string, x double")
    got = {(r.k, r.p): r.v for r in exact_percentiles(df, ["k"], "x", [0.05, 0.5, 0.9]).collect()}
    for p in (0.05, 0.5, 0.9):
        assert got["a", p] == pytest.approx(np.quantile(xs, p), rel=1e-12)
    assert got["i", 0.5] == 1.0 and got["i", 0.05] == float("-inf") and got["i", 0.9] == float("inf")
    close = {r.p: r.v for r in exact_percentiles(df.where("k = 'a'"), ["k"], "x", [0.5], continuous=False, tolerance=0.25).collect()}
    assert abs(close[0.5] - discrete(xs, 0.5)) <= 0.25


def test_no_rows_and_no_keys(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert [(r.p, r.n, r.v) for r in exact_percentiles(df, [], "x", [0.5]).collect()] == [(0.5, 2, 1.5)]
    assert exact_percentiles(df.limit(0), [], "x", [0.5]).collect() == []
    assert cell_percentiles(count_cells(df.limit(0), [], "x"), [0.5]).collect() == []


def test_cells_of_days_are_combined(spark, groups):
    rows = [(k, g, float(v), i % 3) for (k, g), vs in groups.items() if k for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, g int, x double, day int")
    parts = [count_cells(df.where(F.col("day") == d), ["k", "g"], "x", 7) for d in range(3)]
    got = {(r.k, r.g, r.p): r for r in cell_percentiles(merge_cells(*parts), [0.05, 0.5, 0.95], 7).collect()}
    for (k, g), vs in groups.items():
        for p in (0.05, 0.5, 0.95):
            if k:
                exact = discrete(vs, p)
                assert got[k, g, p].n == len(vs) and abs(got[k, g, p].v - exact) <= abs(exact) * 2**-8


def test_a_hot_group_is_spread_where_intervals_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_BROADCAST", 0)
    df = spark.range(40_000).selectExpr("case when id % 3 = 0 then 0 else id % 500 end k", "(id * 7919) % 10007 x")
    got = exact_percentiles(df, ["k"], "x", [0.5], continuous=False)
    want = {r.k: r.v for r in df.groupBy("k").agg(F.expr("percentile_disc(0.5) within group (order by x)").alias("v")).collect()}
    assert {r.k: float(r.v) for r in got.collect()} == {k: float(v) for k, v in want.items()}
    rows = P._within(df.selectExpr("k k0", "x v"), spark.createDataFrame([(0, 0, 10_006)], "rk0 long, rlo long, rhi long"), 1, ["k0"])
    assert "pmod(xxhash64" in rows._jdf.queryExecution().optimizedPlan().toString() and rows.count() == df.where("k = 0").count()
