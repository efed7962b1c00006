"""Queries on a small plant: pumps measured by gauges, with results by plain loops over the same rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegraph.engine import VOCABULARY, Engine
from tidegraph.plans import queries
from tidegraph.session import shared_folder
from tidegraph.sources.graph import TripleStore
from tidegraph.sources.series import FrameSource, HistorySource, InconsistentDatatype, MemorySource, TableSource, TimeSeriesTable
from tidegraph.sparql.parser import QueryError
from tidegraph.streaming.available import readings_stream, run_available
from tidegraph.terms import RDF, XSD

PLANT = "urn:plant#"
HEAD = f"PREFIX xsd: <{XSD}> PREFIX m: <{VOCABULARY}> PREFIX pl: <{PLANT}> "
#: Levels every four seconds over midnight, of the gauges of an intake and an outlet pump.
LEVELS = {"qa": [4, 7, 40, 12, 55, 90, 31, 60, 8, 73], "qb": [5, 5, 41, 13, 50, 91, 30, 66, 9, 70]}
START = datetime(2023, 3, 5, 23, 59, 40)
TRIPLES = "s string, p string, o string, o_kind string, o_dt string, o_lang string"
PUMP = {"qa": "intake", "qb": "outlet"}
ROWS = [(PUMP[i], "g" + i[1], START + timedelta(seconds=4 * k), v) for i, vs in LEVELS.items() for k, v in enumerate(vs)]
MIDNIGHT = "2023-03-06T00:00:00"


def plant_triples():
    iri = lambda s, p, o: (s, p, o, "iri", None, None)
    text = lambda s, p, o, dt=XSD + "string", lang=None: (s, p, o, "literal", dt, lang)
    out = [iri(PLANT + "intake", PLANT + "drawsFrom", PLANT + "lake")]
    for i, kind in ("qa", "Intake"), ("qb", "Outlet"):
        pump, gauge, series = PLANT + PUMP[i], PLANT + "g" + i[1], PLANT + "series" + i[1]
        out += [iri(pump, RDF + "type", PLANT + kind), iri(pump, PLANT + "measuredBy", gauge), iri(gauge, VOCABULARY + "hasTimeseries", series), iri(series, VOCABULARY + "hasDatatype", XSD + "unsignedInt"), text(series, VOCABULARY + "hasExternalId", i)]
    return out


@pytest.fixture(scope="module")
def readings(spark):
    rows = [(i, START + timedelta(seconds=4 * k), v) for i, vs in LEVELS.items() for k, v in enumerate(vs)]
    return spark.createDataFrame(rows, "id string, timestamp timestamp, value bigint").cache()


@pytest.fixture(scope="module")
def engine(spark, readings):
    return Engine(spark.createDataFrame(plant_triples() * 2, TRIPLES)).set_time_series(FrameSource(readings))


def ask(engine, query):
    df = engine.execute_hybrid_query(HEAD + query)
    return [tuple(x.replace(PLANT, "") if isinstance(x, str) else x for x in r) for r in df.collect()]


def same(got, want):
    return sorted(got, key=str) == sorted(want, key=str)


def plan(engine, query):
    return engine.execute_hybrid_query(HEAD + query)._jdf.queryExecution().executedPlan().toString()


LEVEL = "?x pl:measuredBy ?g . ?g m:hasTimeseries ?q . ?q m:hasDataPoint ?d . ?d m:hasValue ?v ; m:hasTimestamp ?t . "
VALUE = "?x pl:measuredBy/m:hasTimeseries/m:hasDataPoint ?d . ?d m:hasValue ?v . "
LATE = f'FILTER(?t >= "{MIDNIGHT}Z"^^xsd:dateTime) '
AFTER = [r for r in ROWS if r[2] >= datetime.fromisoformat(MIDNIGHT)]


def sums(rows, key, f=sum):
    out = {}
    for r in rows:
        out.setdefault(key(r), []).append(r[3])
    return {k: f(v) for k, v in out.items()}


def test_names_alone(engine):
    assert same(ask(engine, "SELECT ?g ?x WHERE { ?g ^pl:measuredBy ?x }"), [("ga", "intake"), ("gb", "outlet")])


def test_ranges_of_time_and_value(engine):
    got = ask(engine, f'SELECT ?x ?t ?v WHERE {{ {LEVEL} ?x a pl:Outlet FILTER(?v > 10 && ?v <= 66) FILTER(?t <= "{MIDNIGHT}Z"^^xsd:dateTime) }}')
    assert same(got, [(x, t, v) for x, _, t, v in ROWS if x == "outlet" and 10 < v <= 66 and t <= datetime.fromisoformat(MIDNIGHT)]) and len(got) == 3


def test_parts_that_only_a_time_connects(engine):
    q = """SELECT ?t ?u ?v WHERE { ?p a pl:Intake ; pl:measuredBy/m:hasTimeseries ?a . ?a m:hasDataPoint ?d . ?d m:hasTimestamp ?t ; m:hasValue ?u .
      ?r a pl:Outlet ; pl:measuredBy/m:hasTimeseries ?b . ?b m:hasDataPoint ?e . ?e m:hasTimestamp ?t ; m:hasValue ?v . FILTER(?u > ?v) }"""
    pairs = [(START + timedelta(seconds=4 * k), u, v) for k, (u, v) in enumerate(zip(LEVELS["qa"], LEVELS["qb"])) if u > v]
    assert same(ask(engine, q), pairs) and len(pairs) == 4
    assert "CartesianProduct" not in plan(engine, q) and "NestedLoop" not in plan(engine, q)


def test_sums_of_pumps(engine):
    assert same(ask(engine, f"SELECT ?x (SUM(?v) AS ?all) WHERE {{ {LEVEL} {LATE} }} GROUP BY ?x"), sums(AFTER, lambda r: r[0]).items())


def test_periods_by_parts_of_time(engine):
    got = ask(engine, f"SELECT ?day ?hour (COUNT(?v) AS ?n) (MAX(?v) AS ?top) WHERE {{ {LEVEL} BIND(day(?t) AS ?day) BIND(hours(?t) AS ?hour) }} GROUP BY ?day ?hour")
    by = lambda f: sums(ROWS, lambda r: (r[2].day, r[2].hour), f)
    assert same(got, [(*k, n, by(max)[k]) for k, n in by(len).items()]) and len(got) == 2


def test_labels_of_groups_and_having(engine):
    q = f'SELECT (CONCAT(STR(?g), "@", ?slot) AS ?label) (MIN(?v) AS ?low) WHERE {{ {LEVEL} BIND(xsd:integer(FLOOR(m:DateTimeAsSeconds(?t) / 8.0)) - 209757600 AS ?slot) }} GROUP BY ?g ?slot HAVING (MAX(?v) >= 60)'
    slot = lambda t: int((t - datetime(1970, 1, 1)).total_seconds()) // 8 - 209757600
    low, high = (sums(ROWS, lambda r: f"{r[1]}@{slot(r[2])}", f) for f in (min, max))
    assert same(ask(engine, q), [(k, low[k]) for k in low if high[k] >= 60])


def test_values_joined_in_order(engine):
    q = f'SELECT ?g ?day (GROUP_CONCAT(?v; separator="/") AS ?all) WHERE {{ {LEVEL} BIND(day(?t) AS ?day) }} GROUP BY ?g ?day'
    assert same(ask(engine, q), [(*k, v) for k, v in sums(ROWS, lambda r: (r[1], r[2].day), lambda vs: "/".join(map(str, vs))).items()])
    assert ask(engine, f'SELECT (GROUP_CONCAT(DISTINCT ?v; separator=",") AS ?all) WHERE {{ {LEVEL} FILTER(?v < 10) }}') == [("4,5,7,8,9",)]


def test_existence(engine):
    read = "?g m:hasTimeseries ?q . ?q m:hasDataPoint ?d . ?d m:hasValue ?v . "
    gauges = lambda cond: [r[0] for r in ask(engine, f"SELECT ?g WHERE {{ ?x pl:measuredBy ?g FILTER {cond} }}")]
    assert gauges(f"EXISTS {{ {read} FILTER(?v = 91) }}") == ["gb"] and gauges(f"NOT EXISTS {{ {read} FILTER(?v = 91) }}") == ["ga"]
    by = sums(ROWS, lambda r: r[1], lambda vs: sum(v for v in vs if v > 30))
    assert gauges(f"EXISTS {{ SELECT ?g WHERE {{ {read} FILTER(?v > 30) }} GROUP BY ?g HAVING (SUM(?v) > 320) }}") == [g for g, n in by.items() if n > 320] == ["ga"]
    got = ask(engine, f"SELECT ?x (AVG(?v) AS ?mean) WHERE {{ {LEVEL} FILTER EXISTS {{ ?x pl:drawsFrom ?any }} }} GROUP BY ?x")
    assert got == [("intake", sum(LEVELS["qa"]) / 10)]
    q = "SELECT ?x (EXISTS { ?x pl:drawsFrom ?l } AS ?wet) WHERE { ?x pl:measuredBy ?g FILTER(EXISTS { ?x a pl:Outlet } || EXISTS { ?x pl:drawsFrom ?k }) }"
    assert same(ask(engine, q), [("intake", True), ("outlet", False)])


def test_path_to_values_and_order(engine):
    q = "SELECT ?x (MIN(?v) AS ?low) WHERE { ?x pl:measuredBy/m:hasTimeseries/m:hasDataPoint/m:hasValue ?v } GROUP BY ?x ORDER BY DESC(?low)"
    assert ask(engine, q) == [("outlet", 5), ("intake", 4)]
    q = "SELECT ?x ?k WHERE { ?x pl:measuredBy ?g OPTIONAL { ?x pl:drawsFrom ?k } } ORDER BY "
    assert [r[0] for r in ask(engine, q + "?k")] == [r[0] for r in ask(engine, q + "DESC(?k)")] == ["intake", "outlet"]
    first = Engine(engine.store, nulls_last=False)
    assert [r[0] for r in ask(first, q + "?k")] == ["outlet", "intake"] and [r[0] for r in ask(first, q + "DESC(?k)")] == ["intake", "outlet"]


def test_optional_sees_the_left_side(engine):
    got = ask(engine, f"SELECT ?x ?v ?flood WHERE {{ {VALUE} OPTIONAL {{ BIND(?v >= 70 AS ?flood) FILTER(?flood) }} }}")
    assert same(got, [(x, v, True if v >= 70 else None) for x, _, _, v in ROWS])


def test_minus(engine):
    q = f"SELECT ?x ?v WHERE {{ {VALUE} MINUS {{ ?d m:hasValue ?v . FILTER(?v >= 31) }} }}"
    assert same(ask(engine, q), [(x, v) for x, _, _, v in ROWS if v < 31])
    assert "LeftAnti" not in plan(engine, q)  # a repeated pattern is a filter
    assert len(ask(engine, "SELECT ?x WHERE { ?x pl:measuredBy ?g MINUS { ?y a pl:Outlet } }")) == 2
    q = f"SELECT ?x ?v WHERE {{ {VALUE} MINUS {{ ?x a pl:Outlet . ?d m:hasValue ?v . ?q m:hasDataPoint ?d FILTER(?v > 60) }} }}"
    assert same(ask(engine, q), [(x, v) for x, _, _, v in ROWS if x != "outlet" or v <= 60])


def test_in_values_if(engine):
    assert same(ask(engine, f"SELECT ?x ?v WHERE {{ {VALUE} FILTER(?v IN (7, (25+5), (100-9))) }}"), [(x, v) for x, _, _, v in ROWS if v in (7, 30, 91)])
    assert same(ask(engine, f"SELECT ?x ?v WHERE {{ {VALUE} VALUES ?w {{ 8 66 400 }} FILTER(?v = ?w) }}"), [("intake", 8), ("outlet", 66)])
    assert same(ask(engine, f"SELECT ?x (IF(?v < 50, 0, ?v) AS ?y) WHERE {{ {VALUE} }}"), [(x, 0 if v < 50 else v) for x, _, _, v in ROWS])
    assert len(ask(engine, f"SELECT DISTINCT ?x (IF(?v < 50, 0, ?v) AS ?y) WHERE {{ {VALUE} }}")) == len({(x, 0 if v < 50 else v) for x, _, _, v in ROWS})


def test_union_keeps_repeats(engine):
    part = lambda cond: f"{{ {VALUE} FILTER({cond}) }}"
    q = f"SELECT ?x ?v WHERE {{ {part('?v > 72')} UNION {part('?v > 90')} UNION {part('?v = 5')} }}"
    assert same(ask(engine, q), [(x, v) for x, _, _, v in ROWS for cond in (v > 72, v > 90, v == 5) if cond])


def test_higher_neighbours_or_the_reading_itself(engine):
    q = """SELECT ?g ?t ?v (COALESCE(?w, ?v) AS ?c) WHERE { ?g m:hasTimeseries ?q . ?q m:hasDataPoint ?d . ?d m:hasTimestamp ?t ; m:hasValue ?v BIND(m:DateTimeAsSeconds(?t) AS ?at)
      OPTIONAL { ?g m:hasTimeseries/m:hasDataPoint ?e . ?e m:hasTimestamp ?u ; m:hasValue ?w BIND(m:DateTimeAsSeconds(?u) AS ?near) FILTER(?near >= ?at - 4 && ?near <= ?at + 4 && ?w > ?v) } }"""
    want = []
    for i, vs in LEVELS.items():
        for k, v in enumerate(vs):
            want += [("g" + i[1], START + timedelta(seconds=4 * k), v, x) for x in [x for x in vs[max(0, k - 1) : k + 2] if x > v] or [v]]
    assert same(ask(engine, q), want)


@pytest.mark.parametrize("bounds", ["?b > ?a && ?b <= ?a + 90", "?a < ?b && ?b - 90 <= ?a", "?b - ?a <= 90 && 0 < ?b - ?a", "!(?b <= ?a) && ?b <= ?a + 90"])
def test_optional_within_a_span_joins_by_bucket(spark, bounds):
    rng = random.Random(9)
    # the times lie on both sides of 1970
    rows = [(f"q{k}", datetime(1970, 1, 1) + timedelta(seconds=rng.randrange(-3000, 3000)), rng.randrange(50)) for k in "aaab" for _ in range(150)]
    engine = Engine(spark.createDataFrame(plant_triples(), TRIPLES)).set_time_series(FrameSource(spark.createDataFrame(rows, "id string, timestamp timestamp, value bigint")))
    q = f"""SELECT ?g ?v ?a ?b WHERE {{ {LEVEL} BIND(m:DateTimeAsSeconds(?t) AS ?a) OPTIONAL {{ ?g m:hasTimeseries ?q2 . ?q2 m:hasDataPoint ?d2 .
      ?d2 m:hasTimestamp ?t2 ; m:hasValue ?v2 . BIND(m:DateTimeAsSeconds(?t2) AS ?b) FILTER({bounds} && ?v2 > ?v) }} }}"""
    sec = lambda t: int((t - datetime(1970, 1, 1)).total_seconds())
    want = []
    for i, t, v in rows:
        near = [sec(u) for j, u, x in rows if i == j and x > v and 0 < sec(u) - sec(t) <= 90]
        want += [("g" + i[1], v, sec(t), b) for b in near or [None]]
    assert same(ask(engine, q), want)
    text = engine.execute_hybrid_query(HEAD + q)._jdf.queryExecution().optimizedPlan().toString()
    # without both bounds as comparisons the gauge alone is the key
    assert (" div 89)" in next(x for x in text.splitlines() if "Join LeftOuter" in x)) == ("!" not in bounds)


def test_concat_by_period_holds_every_reading(spark, tmp_path):
    triples = [("case:w", "types:hasSensor", "case:s", "iri", None, None), ("case:s", "otit:hasTimeseries", "case:t", "iri", None, None)]
    triples += [("case:t", "otit:hasDatatype", "xsd:long", "iri", None, None), ("case:t", "otit:hasExternalId", "x", "literal", "xsd:string", None)]
    spark.createDataFrame(triples, TRIPLES).write.parquet(f"{tmp_path}/triples.parquet")
    at = [datetime(2022, 1, 1, 5, 50), datetime(2022, 1, 1, 5, 59, 59), datetime(2022, 1, 1, 6), datetime(2022, 3, 1), datetime(2022, 3, 1, 0, 9)]
    spark.createDataFrame([("x", t, v) for v, t in reversed(list(enumerate(at)))], "id string, timestamp timestamp, value bigint").write.parquet(f"{tmp_path}/ts1.parquet")
    spark.createDataFrame([], "id string, ts timestamp, v int").write.parquet(f"{tmp_path}/ts.parquet")
    got = sorted(tuple(r) for r in queries.QUERIES["group_concat_periods"](spark, str(tmp_path)).select("w", "period", "cc").collect())
    period = lambda t: int((t - datetime(1970, 1, 1)).total_seconds()) // 600
    assert got == [("case:w", period(at[0]), "0-1"), ("case:w", period(at[2]), "2"), ("case:w", period(at[3]), "3-4")]


def test_paths(engine):
    assert same(ask(engine, "SELECT ?a ?b WHERE { ?a (pl:measuredBy|m:hasTimeseries)+ ?b }"), [p for x, g in (("intake", "a"), ("outlet", "b")) for p in ((x, "g" + g), (x, "series" + g), ("g" + g, "series" + g))])
    assert same(ask(engine, "SELECT ?b WHERE { pl:outlet (pl:measuredBy|m:hasTimeseries)* ?b }"), [("outlet",), ("gb",), ("seriesb",)])
    assert ask(engine, "SELECT ?a WHERE { ?a (pl:measuredBy/m:hasTimeseries)+ pl:seriesa }") == [("intake",)]
    assert ask(engine, "SELECT ?g WHERE { ?g ^pl:measuredBy pl:intake }") == [("ga",)]
    assert ask(engine, "SELECT ?o WHERE { pl:intake !(a|pl:measuredBy) ?o }") == [("lake",)]
    assert same(ask(engine, "SELECT ?o WHERE { pl:outlet pl:measuredBy? ?o }"), [("gb",), ("outlet",)])


def test_slices_aggregates_and_terms(engine):
    values = sorted((v for *_, v in ROWS), reverse=True)
    assert ask(engine, f"SELECT ?v WHERE {{ {VALUE} }} ORDER BY DESC(?v) LIMIT 3 OFFSET 2") == [(v,) for v in values[2:5]]
    assert ask(engine, f"SELECT (COUNT(*) AS ?n) (COUNT(DISTINCT ?x) AS ?k) (MIN(?v) AS ?a) (SAMPLE(?v) AS ?b) WHERE {{ {VALUE} }}") == [(20, 2, 4, 4)]
    assert ask(engine, f"SELECT (m:nestAggregation(?v) AS ?all) WHERE {{ {LEVEL} }} GROUP BY ?x ORDER BY ?x")[0] == (LEVELS["qa"],)
    assert ask(engine, "SELECT (SUM(?y) AS ?n) WHERE { ?x pl:absent ?y }") == [(0,)] and ask(engine, "SELECT ?x WHERE { ?x pl:absent ?y }") == []
    assert ask(engine, "SELECT ?x ?l WHERE { ?x pl:measuredBy ?g OPTIONAL { ?x pl:drawsFrom ?l } FILTER(BOUND(?l)) }") == [("intake", "lake")]
    assert ask(engine, 'SELECT ?i (LANG(?i) AS ?l) (isLiteral(?i) AS ?k) WHERE { pl:seriesb m:hasExternalId ?i FILTER(STRENDS(?i, "b")) }') == [("qb", "", True)]
    assert ask(engine, "SELECT (7 / 0 AS ?a) (ROUND(-2.5) AS ?b) (-(3) AS ?c) (\"x\" + 1 AS ?d) (1 / 2 AS ?e) WHERE {}") == [(None, -2.0, -3, None, 0.5)]
    assert ask(engine, 'SELECT (STRDT("8", xsd:integer) * 2 AS ?a) (STR(IRI("urn:a")) AS ?b) (STRLANG("x", "nb") AS ?c) (STR(BNODE("k")) AS ?d) WHERE {}') == [(16, "urn:a", "x", "_:k")]
    assert len(ask(engine, "SELECT REDUCED ?k WHERE { ?x a ?k }")) == 2


def test_sources(spark, readings, engine):
    q = HEAD + f"SELECT ?x (SUM(?v) AS ?n) WHERE {{ {LEVEL} {LATE} }} GROUP BY ?x ORDER BY ?x"
    want = [n for _, n in sorted(sums(AFTER, lambda r: r[0]).items())]
    of = lambda source: [r["n"] for r in Engine(engine.store).set_time_series(source).execute_hybrid_query(q).collect()]
    assert of(MemorySource({i: readings.where(f"id = '{i}'").select("timestamp", "value") for i in LEVELS})) == want
    assert of(HistorySource(lambda start, end: readings.where(f"timestamp >= '{start}'"))) == want


def test_partitions_are_pruned_and_sub_selects_see_all(spark, readings, engine, tmp_path):
    path = str(tmp_path / "parted")
    readings.selectExpr("*", "year(timestamp) a", "month(timestamp) b", "day(timestamp) c").write.parquet(path, partitionBy=["a", "b", "c"])
    table = TimeSeriesTable(XSD + "unsignedInt", path=path, year_column="a", month_column="b", day_column="c")
    parted = Engine(engine.store).set_time_series(TableSource(spark, [table]))
    q = f"SELECT ?x (SUM(?v) AS ?n) WHERE {{ {LEVEL} {LATE} }} GROUP BY ?x"
    assert same(ask(parted, q), sums(AFTER, lambda r: r[0]).items())
    scan = next(x for x in plan(parted, q).split("PartitionFilters: ")[1:] if "c#" in x.split("]")[0] or "a#" in x.split("]")[0])
    assert "2023" in scan.split("PushedFilters")[0]
    q = f"SELECT ?x ?t ?n WHERE {{ {LEVEL} {{ SELECT ?x (COUNT(?v) AS ?n) WHERE {{ {LEVEL} }} GROUP BY ?x }} {LATE} }}"
    assert same(ask(parted, q), [(x, t, 10) for x, _, t, _ in AFTER])


@pytest.mark.parametrize(
    "where, rows",
    [
        (f"{LEVEL} {{ SELECT ?x (COUNT(?t) AS ?n) WHERE {{ {LEVEL} }} GROUP BY ?x }}", 10),
        (f"?x pl:measuredBy ?y {{ SELECT ?x ?t ?v WHERE {{ {LEVEL} }} ORDER BY ?t ?x LIMIT 12 }}", 2),
        (f"{{ SELECT ?x ?t (COUNT(?v) AS ?n) WHERE {{ {LEVEL} }} GROUP BY ?x ?t }}", 10),
        (f"{{ ?x a ?k MINUS {{ {LEVEL} FILTER(?v < 6) }} }} {LEVEL}", 0),
        (f"{{ ?x a ?k FILTER NOT EXISTS {{ {LEVEL} FILTER(?v < 6) }} }} {LEVEL}", 0),
        (f"{{ ?x a ?k OPTIONAL {{ {LEVEL} FILTER(?v < 6) }} }} {{ SELECT ?x ?t WHERE {{ {LEVEL} }} }}", 0),
    ],
)
def test_bounds_prune_no_reading_that_counts(engine, readings, where, rows):
    history = Engine(engine.store).set_time_series(HistorySource(lambda start, end: readings.where(f"timestamp >= '{start}'") if start else readings))
    q = f"SELECT * WHERE {{ {where} {LATE} }}"
    got = ask(history, q)
    assert same(got, ask(engine, q)) and len(got) == rows
    if "COUNT(?t)" in where:
        assert {r[-1] for r in got} == {10}


def test_stream(spark, readings, engine, tmp_path):
    readings.repartition(3).write.parquet(str(tmp_path / "r"))
    readings.write.parquet(str(tmp_path / "r1"))  # a neighbour whose name goes on, to be left alone
    q = HEAD + f"SELECT ?x (SUM(?v) AS ?n) WHERE {{ {LEVEL} {LATE} }} GROUP BY ?x"
    stream = readings_stream(spark, str(tmp_path / "r"), readings.schema, ("timestamp", "1 hour"), files_per_trigger=1)
    got = run_available(Engine(engine.store).set_time_series(FrameSource(stream)).execute_hybrid_query(q))
    assert sorted(r["n"] for r in got.collect()) == sorted(sums(AFTER, lambda r: r[0]).values())
    plain = HEAD + f"SELECT ?x ?v WHERE {{ {LEVEL} {LATE} }}"
    readings.coalesce(1).write.parquet(str(tmp_path / "whole"))
    for path in (tmp_path / "r", next((tmp_path / "whole").glob("*.parquet"))):
        rows = run_available(Engine(engine.store).set_time_series(FrameSource(readings_stream(spark, str(path), readings.schema))).execute_hybrid_query(plain), "append")
        assert rows.count() == 10


def test_inconsistent_datatypes(spark, readings):
    rows = [r if not (r[1].endswith("hasDatatype") and r[0].endswith("b")) else (*r[:2], XSD + "double", *r[3:]) for r in plant_triples()]
    e = Engine(spark.createDataFrame(rows, TRIPLES)).set_time_series(FrameSource(readings))
    with pytest.raises(InconsistentDatatype):
        e.execute_hybrid_query(HEAD + f"SELECT ?v WHERE {{ {VALUE} }}")


@pytest.mark.parametrize("q", ["ASK {?a ?b ?c}", "BASE <http://x> SELECT * WHERE {?a ?b ?c}", "SELECT ?a WHERE {?a ?b}", "SELECT ?a FROM <x> WHERE {?a ?b ?c}", "SELECT ?a WHERE {?a foo:b ?c}", "SELECT ?a WHERE {SERVICE <x> {?a ?b ?c}}", "SELECT ?a WHERE {?a ?b ?A}"])
def test_rejected(engine, q):
    with pytest.raises(QueryError):
        engine.execute_hybrid_query(q)


def test_named_graphs(spark):
    rows = [(PLANT + s, PLANT + "p", PLANT + o, "iri", None, None, PLANT + g) for s, o, g in (("a", "b", "g1"), ("a", "b", "g2"), ("b", "c", "g2"))]
    e = Engine(spark.createDataFrame(rows, TRIPLES + ", g string"))
    assert same(ask(e, "SELECT ?a ?b WHERE { ?a pl:p ?b }"), [("a", "b"), ("b", "c")])
    assert same(ask(e, "SELECT ?g ?a WHERE { GRAPH ?g { ?a pl:p ?b } }"), [("g1", "a"), ("g2", "a"), ("g2", "b")])
    assert ask(e, "SELECT ?a WHERE { GRAPH pl:g1 { ?a pl:p ?b } }") == [("a",)]


def test_a_predicate_of_most_triples_is_many_tasks(spark):
    rows = spark.range(60_000).selectExpr("concat('urn:s', id) s", "case when id % 4 = 0 then concat('urn:p', id % 7) else 'urn:hot' end p", "concat('urn:o', id) o", "'iri' o_kind", "cast(null as string) o_dt", "cast(null as string) o_lang")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        store = TripleStore(rows)
        files = store.triples.where("p = 'urn:hot'").select("s", F.input_file_name().alias("f")).groupBy("f").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) >= 10 and max(r["count"] for r in files) < 45_000 / 4


def test_a_saved_graph(spark, engine, readings, tmp_path):
    engine.store.save(str(tmp_path / "graph"))
    loaded = Engine(TripleStore.load(spark, str(tmp_path / "graph"))).set_time_series(FrameSource(readings))
    q = f"SELECT ?x (SUM(?v) AS ?all) WHERE {{ {LEVEL} ?x ?p ?o }} GROUP BY ?x"
    assert same(ask(loaded, q), ask(engine, q)) and loaded.store.triples.count() == engine.store.triples.count()
    assert "PartitionFilters: [isnotnull(p" in plan(loaded, "SELECT ?x WHERE { ?x a pl:Intake }")


def compatible(a, b):
    return all(a[k] == b[k] for k in a.keys() & b.keys())


@pytest.mark.parametrize("kind", ["join", "optional", "minus", "exists"])
def test_unbound_variables_by_brute_force(spark, kind):
    """Solutions with any of two variables unbound, on either side, against the definitions of compatible solutions."""
    rng = random.Random(4)
    rows, sides = [], []
    for side in "lr":
        own = [{k: rng.randrange(4) for k in "uw" if rng.random() < 0.7} | {side: i} for i in range(14)]
        sides.append(own)
        rows += [(f"urn:{side}{r[side]}", f"{PLANT}{side}{k}", str(v), "literal", XSD + "integer", None) for r in own for k, v in r.items()]
    e = Engine(spark.createDataFrame(rows, TRIPLES))
    part = lambda s: f"?{s}0 pl:{s}{s} ?{s} OPTIONAL {{ ?{s}0 pl:{s}u ?u }} OPTIONAL {{ ?{s}0 pl:{s}w ?w }} "
    middle = {"join": "{ %s }", "optional": "OPTIONAL { %s }", "minus": "MINUS { %s }", "exists": "FILTER EXISTS { %s }"}[kind] % part("r")
    names = "luwr" if kind in ("join", "optional") else "luw"
    q = f"SELECT {' '.join('?' + n for n in names)} WHERE {{ {{ {part('l')} }} {middle} }}"
    left, right = sides
    want = []
    for a in left:
        met = [b for b in right if compatible({k: v for k, v in a.items() if k in "uw"}, b)]
        if kind == "minus":
            want += [] if any((a.keys() & b.keys() & {"u", "w"}) for b in met) else [a]
        elif kind == "exists":
            want += [a] if met else []
        else:
            want += [a | b for b in met] or ([a] if kind == "optional" else [])
    assert same(ask(e, q), [tuple(r.get(n) for n in names) for r in want])


def test_joins_with_unbound_variables_keep_an_equality(engine):
    left = "?x pl:measuredBy ?g OPTIONAL { ?x pl:drawsFrom ?k } "
    right = "?x a ?kind OPTIONAL { ?x pl:drawsFrom ?k } "
    for q in (f"{{ {left} }} {{ {right} }}", f"{left} OPTIONAL {{ {right} }}", f"{left} MINUS {{ {right} }}", f"{left} FILTER NOT EXISTS {{ {right} }}"):
        text = plan(engine, f"SELECT * WHERE {{ {q} }}")
        assert "CartesianProduct" not in text and "NestedLoop" not in text, q


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

    class Conf:
        get = staticmethod(lambda *_: None)

    class Session:
        sparkContext, conf = Context, Conf

    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        assert shared_folder(Session) == held.get()
    else:
        with pytest.raises(RuntimeError):
            shared_folder(Session)
