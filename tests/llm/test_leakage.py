"""Leak detection on planted passages, and its parts against brute force."""

import numpy as np
import pytest

from tidegraph.llm.leakage import DRIFT, Q, _find, aligned_words, build_index, grams, leaked_items, stream, words_of

RNG = np.random.default_rng(10)
VOCABULARY = ["".join(RNG.choice(list("bdfgklmnprst"), 1)[0] + RNG.choice(list("aeiou"), 1)[0] for _ in range(int(n))) for n in RNG.integers(1, 5, 900)]
text = lambda n: [str(w) for w in RNG.choice(VOCABULARY, n)]
INTRO = "read the passage below and answer the question that follows it".split()
ITEMS = {i: INTRO * (i % 2) + text(int(RNG.integers(50, 110))) for i in range(40)}


def planted():
    """(text, items found, items not found)"""
    docs = []
    for i, own in ITEMS.items():
        part = own[: len(own) * 7 // 10]
        changed = [w if k % 11 else "changed" for k, w in enumerate(part)]
        around = lambda ws, sep=" ": sep.join([*text(40), *ws, *text(40)])
        docs.append((around(own), {i}))
        docs.append((around(changed).upper(), {i}))
        docs.append(("\n# ".join(" ".join(changed[k : k + 9]) for k in range(0, len(changed), 9)), {i}))
        docs.append((around([f"<b>{w}</b><br/>\\n" if k % 5 == 0 else w for k, w in enumerate(own)]), {i}))
        docs.append((around(own).replace("e", "е​").replace("a", "ａ"), {i}))
        docs.append((around(own[: len(own) // 4]), set()))
        docs.append((around(own[::2]), set()))
        docs.append((around(sorted(own)), set()))
        docs.append((around(INTRO), set()))
    docs += [(None, set()), ("", set()), (" ".join(text(200_000) + ITEMS[3] + ITEMS[4]), {3, 4})]
    return docs


def test_planted(spark):
    docs = planted()
    df = spark.createDataFrame([(i, d, 7, "x") for i, (d, _) in enumerate(docs)], "doc long, body string, item_id int, row string").repartition(4)
    items = spark.createDataFrame([(i, " ".join(w), 1) for i, w in ITEMS.items()] + [(3, " ".join(ITEMS[3]), 1), (90, None, 1), (91, "", 1), (92, "ab", 1), (None, "x y z", 1)], "item long, text string, doc int")
    want = sorted((i, k) for i, (_, ks) in enumerate(docs) for k in ks)
    for block in (20_000_000, 2_000):
        got = leaked_items(df, "doc", "body", items, "item", "text", block_chars=block, letters=50_000)
        assert got.columns == ["doc", "item"] and sorted(map(tuple, got.collect())) == want
    assert leaked_items(df.limit(0), "doc", "body", items, "item", "text").collect() == []
    assert leaked_items(df, "doc", "body", items.limit(0), "item", "text").collect() == []


def test_streams():
    letters, begins = stream("Ａ café—ﬁ​ne \\u0041b\\n <i>x</i> &amp; \x1b[31mred")
    assert [bytes(w).decode("utf-32-le") for w in words_of(letters, begins)] == ["a", "cafe", "fine", "ab", "x", "red"]
    assert len(grams(letters)) == len(letters) - Q + 1 and len(grams(letters[:3])) == 0
    a, b = grams(np.arange(100, dtype=np.uint32)), grams(np.arange(50, 150, dtype=np.uint32))
    assert (a[50:] == b[:43]).all()


def brute(item, doc, start):
    best = (0, 0)
    h = {}
    for i in range(len(item)):
        for j in range(len(doc)):
            if abs(j + start - i) > DRIFT:
                continue
            same = item[i] == doc[j]
            s, n = h.get((i - 1, j - 1), (0, 0))
            options = [(s + 2, n + 1) if same else (s - 2, n)]
            for key, cost in (((i - 1, j), 2), ((i, j - 1), 1)):
                s, n = h.get(key, (0, 0))
                options.append((s - cost, n))
            top = max(options)
            h[i, j] = top if top[0] >= 1 else (0, 0)
            best = max(best, h[i, j])
    return best[1]


def test_alignment_by_brute_force():
    rng = np.random.default_rng(11)
    pairs = []
    for _ in range(60):
        item = rng.integers(0, 12, int(rng.integers(1, 45)))
        doc = np.concatenate([rng.integers(0, 12, 9), item[:30], rng.integers(0, 12, 20)])[rng.random(9 + len(item[:30]) + 20) < 0.9]
        pairs.append((item, doc, int(rng.integers(-12, 6))))
    assert aligned_words(pairs).tolist() == [brute(*p) for p in pairs]
    assert aligned_words([]).tolist() == []


def test_index():
    index = build_index([(5, "one two three four"), (6, "two three four five"), (7, ""), (8, "One, two: three four")])
    assert index.ids == [[5, 8], [6], [7]] and (np.diff(index.keys.astype(object)) > 0).all()
    assert index.first[-1] == len(index.item) == len(index.place)
    assert build_index([(1, "")]).least_cover.tolist() == [0]


EDITS = {
    "deleted": lambda w: [x for k, x in enumerate(w) if k % 10 != 5],
    "inserted": lambda w: [y for k, x in enumerate(w) for y in ([x, "foreign"] if k % 10 == 5 else [x])],
    "replaced": lambda w: ["changed" if k % 10 == 5 else x for k, x in enumerate(w)],
    "part": lambda w: [x for k, x in enumerate(w[len(w) // 5 : len(w) // 5 + len(w) * 62 // 100]) if k % 12 != 5],
}


@pytest.mark.parametrize("edit", EDITS)
@pytest.mark.parametrize("n", [12, 60, 400, 800, 1600, 3000])
def test_recall_of_edited_items(edit, n):
    """The edit budget grows with the item, and with it bands and alignments: every tenth word changed loses none."""
    own = {i: text(n) for i in range(6)}
    index = build_index([(i, " ".join(w)) for i, w in own.items()])
    docs = [" ".join([*text(200), *EDITS[edit](w), *text(200)]) for w in own.values()]
    found = {(d, i) for d, k in zip(*_find(docs, index)) for i in index.ids[k]}
    assert found == {(i, i) for i in own}
    if n > 12:
        assert _find([" ".join([*text(50), *w[: n * 2 // 5], *text(50)]) for w in own.values()], index) == ([], [])


def test_a_sentence_that_many_items_share():
    own = {i: INTRO * 2 + text(30) for i in range(1500)}
    docs = [" ".join([*text(40), *INTRO * 2, *text(40)]), " ".join([*text(40), *own[7], *text(40), *own[8]])]
    for most in (4_000_000, 5_000):  # also in many slices of one document
        index = build_index([(i, " ".join(w)) for i, w in own.items()], 0.6)
        assert sorted(zip(*_find(docs, index, most))) == [(1, 7), (1, 8)]
    # items that consist of shared grams alone are still found
    base = text(40)
    index = build_index([(i, " ".join([*base[:20], f"only{i}", *base[20:]])) for i in range(300)])
    assert len(_find([" ".join(base)], index, 3_000)[0]) == 300


def test_repeated_numbers_and_texts(spark):
    w, x = text(40), text(50)
    docs = spark.createDataFrame([(1, " ".join(w + x)), (1, " ".join(w + x)), (2, "nothing"), (3, None)], "row long, text string")
    items = spark.createDataFrame([(4, " ".join(w)), (4, " ".join(x)), (5, " ".join(w).upper()), (5, " ".join(w).upper()), (None, " ".join(w)), (6, None), (7, "")], "item long, text string")
    for chars in (4_000_000, 150):  # one block and several
        got = leaked_items(docs, "row", "text", items, "item", "text", block_chars=chars)
        assert sorted(map(tuple, got.collect())) == [(1, 4), (1, 4), (1, 5), (1, 5)]
    assert leaked_items(docs.limit(0), "row", "text", items, "item", "text").collect() == []


@pytest.mark.parametrize("share, n", [(0.2, 1), (0.5, 1), (0.95, 0)])
def test_share(spark, share, n):
    own = ITEMS[1]
    df = spark.createDataFrame([(1, " ".join(own[: len(own) * 3 // 4]))], "d long, t string")
    items = spark.createDataFrame([(1, " ".join(own))], "i long, t string")
    assert leaked_items(df, "d", "t", items, "i", "t", share=share).count() == n
    few = spark.createDataFrame([(1, " ".join([*text(80), *own[20 : 20 + -(-len(own) // 5)], *text(80)]))], "d long, t string")
    assert leaked_items(few, "d", "t", items, "i", "t", share=share).count() == (share == 0.2)
