"""Packing keeps everything, keeps to the capacity, and wastes little."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import packing
from tidegraph.llm.queries import VOCABULARY
from tidegraph.llm.packing import _across, _brackets, pack, vocabulary_count, word_punct_count


def check(rows, sizes, capacity):
    by_row, by_bin = {}, {}
    for r in rows:
        by_row.setdefault(r["row"] if "row" in r.__fields__ else r[0], []).append(r)
        if r.container is not None:
            by_bin[r.container] = by_bin.get(r.container, 0) + r.piece_size
    assert max(by_bin.values(), default=0) <= capacity
    assert {k: sum(r.piece_size for r in v) for k, v in by_row.items()} == dict(enumerate(sizes))
    for k, v in by_row.items():
        assert sorted(r.piece for r in v) == list(range(len(v)))
        assert len(v) == max(1, -(-sizes[k] // capacity))
        assert all((r.container is None) == (r.piece_size == 0) for r in v)
    return by_bin


@pytest.mark.parametrize("rows_per_sweep", [200_000, 150])
def test_random_sizes(spark, rows_per_sweep):
    rng = np.random.default_rng(8)
    sizes = [int(x) for x in np.minimum(rng.lognormal(4.5, 1.1, 900), 3000)] + [0, 0, 500, 1000, 1500, 256] + [120] * 60
    df = spark.createDataFrame([(i, s, "x", 1) for i, s in enumerate(sizes)], "id long, size long, item string, bin int").repartition(5)
    bins = check(pack(df, "id", F.col("size"), 500, rows_per_sweep).collect(), sizes, 500)
    assert sum(bins.values()) / (len(bins) * 500) > 0.97


def test_small_items_close_small_gaps(spark):
    sizes = [150, 10] * 50
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, size long")
    assert set(check(pack(df, "id", F.col("size"), 160).collect(), sizes, 160).values()) == {160}


def test_small_and_odd_cases(spark):
    one = lambda sizes: pack(spark.createDataFrame(list(enumerate(sizes)), "id long, size long"), "id", F.col("size"), 100).collect()
    check(one([51] * 7), [51] * 7, 100)
    assert len(check(one([1] * 250), [1] * 250, 100)) == 3
    check(one([100, 200, 300]), [100, 200, 300], 100)
    assert [tuple(r) for r in one([0])] == [(0, 0, 0, None)]
    assert [tuple(r) for r in one([None])] == [(0, 0, 0, None)]
    assert one([101])[0].piece_size in (1, 100)
    assert pack(spark.createDataFrame([], "id long, size long"), "id", F.col("size"), 100).collect() == []
    twice = pack(spark.createDataFrame([(1, 60), (1, 60), (None, 60)], "id long, size long"), "id", F.col("size"), 100).collect()
    assert len(twice) == 3 and len({r.container for r in twice}) == 3
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([], "id long, size long"), "id", F.col("size"), 3)


def test_joins_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_BROADCAST", 0)
    sizes = [int(x) for x in np.random.default_rng(3).integers(1, 300, 700)]
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, size long").repartition(3)
    check(pack(df, "id", F.col("size"), 320, 100).collect(), sizes, 320)


def test_brackets_match_by_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(200):
        n = int(rng.integers(0, 40))
        gap = rng.random(n) < 0.5
        size = np.sort(rng.integers(1, 20, n))
        order = np.lexsort((gap, size))
        gap = gap[order]
        stack, want = [], set()
        for i, g in enumerate(gap):
            if not g:
                stack.append(i)
            elif stack:
                want.add((stack.pop(), i))
        a, b = _brackets(size[order], gap) if n else ([], [])
        assert set(zip(map(int, a), map(int, b))) == want


def test_across():
    assert _across([(0, 3, 0), (1, 2, 1), (2, 0, 5)]) == [(0, 0, 1, 0, 1), (1, 0, 2, 0, 2), (0, 1, 2, 2, 2)]


def test_token_counts(spark):
    df = spark.createDataFrame([("a b, c!!",), ("",), (None,), ("x" * 100_000,)], "t string")
    assert [r[0] for r in df.select(word_punct_count(F.col("t"))).collect()] == [5, 0, 0, 1]
    path = Path(VOCABULARY)
    if not path.exists():
        pytest.skip("no vocabulary file")
    more = df.unionByName(spark.createDataFrame([("the cat sat <|endoftext|> it's",), ("naïve 東京",)], "t string"))
    counted = [r["tokens"] for r in vocabulary_count(more, "t", str(path)).collect()]
    # a special token's string is ordinary text: the cat sat < | end of text | > it 's; and bytes of letters outside the vocabulary count each
    assert counted[:3] == [5, 0, 0] and counted[4:] == [12, 7]
