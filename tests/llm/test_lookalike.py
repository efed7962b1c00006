"""Forms of look-alike texts against the Unicode database, and pairs against brute force."""

import unicodedata
from types import SimpleNamespace

import duckdb
import pyarrow as pa
import pytest

from tidegraph.llm import lookalike
from tidegraph.llm.lookalike import DRAWN_APART, LETTERS, form_sql, invisible_ranges, letters_alike, lookalike_classes, lookalike_pairs, published_letters, single_forms, unify_text

ALIKE = [
    ("file ofﬁce", "ﬁle oﬀice"), ("ABC 123", "ＡＢＣ　１２３"), ("café", "café"), ("naïve Ångström", "naïve Ångström"), ("word", "wo​r­d﻿"), ("a b c", "a b c"),
    ("peace", "реасе"), ("TOKEN", "ΤΟΚΕΝ"), ("データ ガ", "ﾃﾞｰﾀ ｶﾞ"), ("ë", "ё"), ("é", "е‍́"), ("a\nb", "a\r\nb"), ("Á", "Ά"), ("ﬃx", "ffix"),
]
UNLIKE = [("a", "A"), ("1", "2"), ("cafe", "café"), ("a b", "ab"), ("a  b", "a b"), ("x²", "x2"), ("a-b", "a–b"), ("ö", "o"), ("½", "1/2"), ("a\tb", "a b")]


def forms(texts):
    con = duckdb.connect()
    con.register("given", pa.table({"i": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())}))
    return [r[1] for r in con.sql(f"select i, {form_sql()} from given order by i").fetchall()]


@pytest.mark.parametrize("a, b", ALIKE)
def test_alike(a, b):
    x, y = forms([a, b])
    assert x == y


@pytest.mark.parametrize("a, b", UNLIKE)
def test_unlike(a, b):
    x, y = forms([a, b])
    assert x != y


def test_forms_are_stable_and_agree_with_the_database():
    assert " " not in single_forms() and "\n" not in single_forms() and not any(c.isascii() for c in single_forms())
    every = [chr(c) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]
    once = forms(every)
    assert forms(once) == once
    for c, f in zip(every, once):
        tag = unicodedata.decomposition(c).split(" ")[0]
        if tag == "<wide>" and c not in single_forms():
            assert f == unicodedata.normalize("NFKC", c)
        if not tag and not any(a <= ord(c) <= b for a, b in invisible_ranges()) and c not in single_forms():
            assert f == unicodedata.normalize("NFC", c)


def test_recall_of_published_letters(spark):
    """Of the letters that the published confusables data call alike, at least 0.9 are unified; the others are named."""
    published = {p[0]: p[1] for p in published_letters(spark._jvm).split()}
    forms = single_forms(letters_alike(spark))
    kept = {c for c, to in published.items() if forms.get(c) == to}
    assert len(published) > 150 and len(kept) >= 0.9 * len(published) and published.keys() - kept == set(DRAWN_APART + "ӏ") & published.keys()
    listed = {p[0]: p[1] for p in LETTERS.split()}
    # the list adds a few letters and contradicts one: the small palochka, drawn like l in most typefaces
    assert [c for c, to in listed.items() if published.get(c, to) != to] == ["ӏ"]


def test_no_result_without_the_published_letters(spark, monkeypatch):
    """Where the confusables data can't be read, or are empty, there is an error and no result of fewer letters."""
    for session in (SimpleNamespace(_jvm=SimpleNamespace(com=spark._jvm.com.no.such.place)), SimpleNamespace()):
        with pytest.raises(RuntimeError, match="ICU"):
            letters_alike(session)
    df = spark.createDataFrame([(1, "Ꭺ"), (2, "A")], "i int, t string")
    assert [tuple(r) for r in lookalike_pairs(df, "i", "t").collect()] == [(1, 2)]

    def broken(jvm):
        raise TypeError("'JavaPackage' object is not callable")

    for reads in (broken, lambda jvm: ""):
        monkeypatch.setattr(lookalike, "published_letters", reads)
        for make in (lookalike_pairs, lookalike_classes, lambda df, i, t: unify_text(df, t)):
            with pytest.raises(RuntimeError, match="ICU"):
                make(df, "i", "t")


def test_classes_of_many_copies(spark):
    """Copies of a text in two encodings make a row each, not pairs; the class of most rows is one row in each table joined to them."""
    df = spark.range(200_000).selectExpr("id", "case when id % 2 = 0 then 'café' else 'cafe\u0301' end t").unionByName(spark.createDataFrame([(-1, "other"), (-2, None), (-3, "")], "id long, t string"))
    got = lookalike_classes(df, "id", "t")
    assert got.count() == 200_001
    counts = sorted(map(tuple, got.groupBy("class", "same_text", "texts").count().collect()))
    assert counts == [(-1, -1, 1, 1), (0, 0, 2, 100_000), (0, 1, 2, 100_000)]


def test_unify_text_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "ﬁ", [1], {"a": 1}), (2, None, None, None), (3, "", [2], None), (4, "​", [], None), (5, "x" * 300_000 + " ", [], None)], "i int, t string, text array<int>, `m n` map<string,int>")
    got = {r.i: r for r in unify_text(df, "t").collect()}
    assert [got[i]["form"] for i in (1, 2, 3, 4)] == ["fi", None, "", ""] and got[5]["form"] == "x" * 300_000 + " "
    assert got[1]["m n"] == {"a": 1} and got[1]["text"] == [1] and got[1]["t"] == "ﬁ"
    assert unify_text(df.limit(0), "t").columns == [*df.columns, "form"] and unify_text(df.limit(0), "t").count() == 0
    with pytest.raises(ValueError):
        unify_text(df, "t", "T")


def test_pairs(spark):
    texts = ["abc", "аbc", "abc", "ａbc", "x", "х", None, "", "​", "﻿", "same", "same"]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(None, "abc", "k"), (0, "abc", "k")]
    df = spark.createDataFrame(rows, "id long, t string, form string")
    f = dict(enumerate(forms([t or "" for t in texts])))
    want = sorted((i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] and texts[j] and texts[i] != texts[j] and f[i] == f[j])
    got = lookalike_pairs(df, "id", "t")
    assert got.columns == ["id_a", "id_b"] and sorted(map(tuple, got.collect())) == want
    assert lookalike_pairs(df.limit(0), "id", "t").collect() == []
    classes = {r.id: r for r in lookalike_classes(df, "id", "t").collect()}
    assert classes.keys() == {i for i, t in enumerate(texts) if t}
    assert want == sorted((i, j) for i in classes for j in classes if i < j and classes[i]["class"] == classes[j]["class"] and classes[i].same_text != classes[j].same_text)
    assert lookalike_classes(df.limit(0), "id", "t").collect() == []
