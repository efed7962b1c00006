"""Queries of the engine, the path language and the mapper over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.engine import Engine
from tidegraph.session import Spool
from tidegraph.sources.graph import TripleStore
from tidegraph.sources.series import FrameSource, HistorySource, TableSource, TimeSeriesTable
from tidegraph.streaming.available import readings_stream, run_available
from tidegraph.stottr.mapping import Mapping, MintingOptions, ResolveIRI, ntriples
from tidegraph.terms import RDF, RDFS, XSD, Iri

PREFIXES = {"rdf": RDF, "rdfs": RDFS, "xsd": XSD, "otit": "urn:series#", "rds": "urn:rds#", "wp": "urn:wp#", "types": "urn:types#", "case": "urn:case#"}
HEAD = "".join(f"PREFIX {p}: <{i}>\n" for p, i in PREFIXES.items())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_stores: dict[tuple[str, str, str], TripleStore] = {}


def _store(spark: SparkSession, d: str, make: Callable[[], TripleStore], kind: str = "triples") -> TripleStore:
    """A graph is prepared once in an application, for all queries on it."""
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _stores:
        _stores[key] = make()
    return _stores[key]


def engine(spark: SparkSession, d: str) -> Engine:
    """The graph of ``triples`` with the readings of ``ts`` (int) and ``ts1`` (long), routed by datatype."""
    ts = table(spark, d, "ts")
    store = _store(spark, d, lambda: TripleStore(table(spark, d, "triples"), PREFIXES))
    tables = [
        TimeSeriesTable(XSD + "int", ts, timestamp_column="ts", value_column="v"),
        TimeSeriesTable(XSD + "long", table(spark, d, "ts1")),
    ]
    return Engine(store, "urn:series#").set_time_series(TableSource(spark, tables))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_E = "e as (select distinct s, p, o, o_kind, o_dt, o_lang from triples)"
_R = "r as (select id, ts t, v from ts where id is not null and ts is not null and v is not null)"
_R1 = "r1 as (select id, timestamp t, value v from ts1 where id is not null and timestamp is not null and value is not null)"
_M = """m as (select st.s site, sl.o site_label, a.o asp, wl.o wtur_label, t.s wtur, h.o ts, i.o id
    from e st join e sl on sl.s = st.s and sl.p = 'rdfs:label' join e a on a.s = st.s and a.p = 'rds:hasFunctionalAspect'
    join e wl on wl.s = a.o and wl.p = 'rdfs:label' join e t on t.o = a.o and t.p = 'rds:hasFunctionalAspectNode'
    join e ga on ga.s = t.s and ga.p = 'rds:hasFunctionalAspect' join e g on g.o = ga.o and g.p = 'rds:hasFunctionalAspectNode'
    join e gt on gt.s = g.s and gt.p = 'rdf:type' and gt.o = 'rds:RA'
    join e na on na.s = g.s and na.p = 'rds:hasFunctionalAspect' join e n on n.o = na.o and n.p = 'rds:hasFunctionalAspectNode'
    join e nt on nt.s = n.s and nt.p = 'rdf:type' and nt.o = 'rds:GAA'
    join e h on h.s = n.s and h.p = 'otit:hasTimeseries' join e l on l.s = h.o and l.p = 'rdfs:label' and l.o = 'Production'
    join e i on i.s = h.o and i.p = 'otit:hasExternalId' where st.p = 'rdf:type' and st.o = 'rds:Site')"""
_PR = f"with {_E}, {_R}, {_M}, x as (select m.*, t, v, epoch_us(t) us from m join r using (id))"
# sensors of widgets with their readings
_SR = f"""with {_E}, {_R1}, w as (select a.s w, a.o s, h.o ts, i.o id from e a join e h on h.s = a.o and h.p = 'otit:hasTimeseries'
    join e i on i.s = h.o and i.p = 'otit:hasExternalId' where a.p = 'types:hasSensor'),
x as (select w.*, t, v, epoch_us(t) us from w join r1 using (id))"""

PRODUCTION = """?site a rds:Site ; rdfs:label ?site_label ; rds:hasFunctionalAspect ?asp . ?asp rdfs:label ?wtur_label .
 ?wtur rds:hasFunctionalAspectNode ?asp ; rds:hasFunctionalAspect ?gsa . ?gs rds:hasFunctionalAspectNode ?gsa ; a rds:RA ; rds:hasFunctionalAspect ?ga .
 ?gen rds:hasFunctionalAspectNode ?ga ; a rds:GAA ; otit:hasTimeseries ?ts . ?ts rdfs:label "Production" . """
READ = "?ts otit:hasDataPoint ?dp . ?dp otit:hasTimestamp ?t . ?dp otit:hasValue ?v . "
SENSOR = "?w types:hasSensor ?s . ?s otit:hasTimeseries ?ts . "
SECONDS = "otit:DateTimeAsSeconds(?t)"


def sparql(name: str, text: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: engine(spark, d).execute_hybrid_query(HEAD + text)
    SQL[name] = sql


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# patterns, filters and series ---------------------------------------------------------------------

sparql(
    "windfarm_ten_minutes",
    f"""SELECT ?site_label ?wtur_label ?year ?month ?day ?hour ?minute_10 (AVG(?v) AS ?avg_val) WHERE {{ {PRODUCTION} {READ}
    BIND(10 * FLOOR(minutes(?t) / 10.0) AS ?minute_10) BIND(hours(?t) AS ?hour) BIND(day(?t) AS ?day) BIND(month(?t) AS ?month) BIND(year(?t) AS ?year)
    FILTER(?t >= "2022-01-01T00:00:00Z"^^xsd:dateTime) }} GROUP BY ?site_label ?wtur_label ?year ?month ?day ?hour ?minute_10""",
    f"""{_PR} select site_label, wtur_label, year(t) "year", month(t) "month", day(t) "day", hour(t) "hour", (minute(t) // 10 * 10)::double minute_10, avg(v) avg_val
    from x where us >= 1640995200000000 group by all""",
)
sparql(
    "hybrid_simple_filter",
    f'SELECT ?wtur ?seconds ?v WHERE {{ {PRODUCTION} {READ} BIND({SECONDS} AS ?seconds) FILTER(?t > "2022-01-22T12:00:00Z"^^xsd:dateTime && ?v < 200000) }}',
    f"{_PR} select wtur, us // 1000000 as seconds, v from x where us > 1642852800000000 and v < 200000",
)
sparql("static_select", "SELECT ?a ?b WHERE { ?a types:hasSensor ?b }", f"with {_E} select s a, o b from e where p = 'types:hasSensor'")
sparql("static_join_literal", 'SELECT ?w ?s WHERE { ?w a types:BigWidget ; rdfs:label "widget 2"@en ; types:hasSensor ?s }', f"with {_E} select a.s w, b.o s from e a join e l on l.s = a.s and l.p = 'rdfs:label' and l.o = 'widget 2' and l.o_lang = 'en' join e b on b.s = a.s and b.p = 'types:hasSensor' where a.p = 'rdf:type' and a.o = 'types:BigWidget'")
sparql("variable_predicate", "SELECT ?p ?o WHERE { case:widget1 ?p ?o }", f"with {_E} select p, o from e where s = 'case:widget1'")
sparql("cross_product", "SELECT ?a ?b WHERE { ?a a rds:Site . ?b a types:BigWidget }", f"with {_E} select a.s a, b.s b from e a, e b where a.p = 'rdf:type' and a.o = 'rds:Site' and b.p = 'rdf:type' and b.o = 'types:BigWidget'")
sparql("hybrid_long_series", f"SELECT ?w (COUNT(?v) AS ?n) (MAX(?v) AS ?most) WHERE {{ {SENSOR} {READ} }} GROUP BY ?w", f"{_SR} select w, count(v) n, max(v) most from x group by w")
sparql("sync_two_series", f"""SELECT ?wtur ?seconds ?a ?b WHERE {{ {PRODUCTION} ?wtur rds:hasFunctionalAspect ?wa . ?wms rds:hasFunctionalAspectNode ?wa ; a rds:LE ; otit:hasTimeseries ?ts2 . ?ts2 rdfs:label "Windspeed" .
    {READ} ?ts2 otit:hasDataPoint ?dp2 . ?dp2 otit:hasTimestamp ?t . ?dp2 otit:hasValue ?v2 . BIND({SECONDS} AS ?seconds) BIND(?v AS ?a) BIND(?v2 AS ?b) }}""",
    f"""{_PR}, w as (select m.wtur, i.o id from m join e a on a.s = m.wtur and a.p = 'rds:hasFunctionalAspect' join e n on n.o = a.o and n.p = 'rds:hasFunctionalAspectNode'
    join e k on k.s = n.s and k.p = 'rdf:type' and k.o = 'rds:LE' join e h on h.s = n.s and h.p = 'otit:hasTimeseries' join e l on l.s = h.o and l.p = 'rdfs:label' and l.o = 'Windspeed' join e i on i.s = h.o and i.p = 'otit:hasExternalId')
    select x.wtur, x.us // 1000000 as seconds, x.v a, r.v b from x join w on w.wtur = x.wtur join r on r.id = w.id and r.t = x.t""")  # fmt: skip

# two parts of the graph that only the time of their readings connects
sparql("sync_by_time", f"""SELECT ?a ?b ?seconds ?v ?v2 WHERE {{ ?ts rdfs:label "Production" ; otit:hasExternalId ?a . {READ} ?ts2 rdfs:label "Windspeed" ; otit:hasExternalId ?b .
    ?ts2 otit:hasDataPoint ?dp2 . ?dp2 otit:hasTimestamp ?t ; otit:hasValue ?v2 . BIND({SECONDS} AS ?seconds) }}""",
    f"""with {_E}, {_R}, x as (select i.o id, l.o label, t, v from e l join e h on h.o = l.s and h.p = 'otit:hasTimeseries' join e i on i.s = l.s and i.p = 'otit:hasExternalId' join r on r.id = i.o where l.p = 'rdfs:label' and l.o in ('Production', 'Windspeed'))
    select a.id a, b.id b, epoch_us(a.t) // 1000000 as seconds, a.v, b.v v2 from x a join x b on a.t = b.t and a.label = 'Production' and b.label = 'Windspeed'""")  # fmt: skip
sparql("reduced_rows", "SELECT REDUCED ?w WHERE { ?w types:hasSensor ?s }", f"with {_E} select s w from e where p = 'types:hasSensor'")


def _named(spark: SparkSession, d: str) -> Engine:
    """The same triples in two named graphs, names of structure in one and literals in the other."""
    graphs = lambda: TripleStore(table(spark, d, "triples").withColumn("g", F.when(F.col("o_kind") == "literal", "urn:g#literals").otherwise("urn:g#structure")), PREFIXES)
    return Engine(_store(spark, d, graphs, "named"), "urn:series#")


@query(f"with {_E} select case when o_kind = 'literal' then 'urn:g#literals' else 'urn:g#structure' end g, count(*) n from e group by all")
def graph_variable(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).execute_hybrid_query(HEAD + "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g")


@query(f"with {_E} select a.s w, l.o l from e a join e l on l.s = a.s and l.p = 'rdfs:label' and l.o_kind = 'literal' where a.p = 'rdf:type' and a.o = 'types:BigWidget'")
def graph_named(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).execute_hybrid_query(HEAD + "SELECT ?w ?l WHERE { GRAPH <urn:g#structure> { ?w a types:BigWidget } GRAPH <urn:g#literals> { ?w rdfs:label ?l } }")


# aggregation --------------------------------------------------------------------------------------

sparql("hybrid_group_sum", f"SELECT ?site_label (SUM(?v) AS ?sum_v) WHERE {{ {PRODUCTION} {READ} }} GROUP BY ?site_label", f"{_PR} select site_label, sum(v)::bigint sum_v from x group by 1")
sparql("hybrid_having", f"SELECT ?wtur (SUM(?v) AS ?sum_v) WHERE {{ {PRODUCTION} {READ} }} GROUP BY ?wtur HAVING (SUM(?v) > 100000000)", f"{_PR} select wtur, sum(v)::bigint sum_v from x group by 1 having sum(v) > 100000000")
sparql(
    "agg_all",
    f"SELECT ?site_label (COUNT(*) AS ?n) (COUNT(?v) AS ?c) (COUNT(DISTINCT ?v) AS ?cd) (SUM(?v) AS ?s) (SUM(DISTINCT ?v) AS ?sd) (AVG(?v) AS ?a) (MIN(?v) AS ?lo) (MAX(?v) AS ?hi) (SUM(?v * 2 + 1) AS ?e) WHERE {{ {PRODUCTION} {READ} }} GROUP BY ?site_label",
    f"{_PR} select site_label, count(*) n, count(v) c, count(distinct v) cd, sum(v)::bigint s, sum(distinct v)::bigint sd, avg(v) a, min(v) lo, max(v) hi, sum(v::bigint * 2 + 1)::bigint e from x group by 1",
)
sparql("agg_distinct_avg", "SELECT ?site_label (ROUND(AVG(DISTINCT ?v)) AS ?a) WHERE { " + PRODUCTION + READ + "} GROUP BY ?site_label", f"{_PR} select site_label, floor(avg(distinct v) + 0.5) a from x group by 1")
sparql("count_distinct_rows", f"SELECT (COUNT(DISTINCT *) AS ?n) WHERE {{ {SENSOR} }}", f"{_SR} select count(distinct (w, s, ts)) n from w")
sparql("group_concat_periods", f'SELECT ?w ?period (GROUP_CONCAT(?v; separator="-") AS ?cc) WHERE {{ {SENSOR} {READ} BIND(xsd:integer(FLOOR({SECONDS} / 600.0)) AS ?period) }} GROUP BY ?w ?period', f"{_SR} select w, us // 600000000 period, string_agg(v::varchar, '-' order by t, v::varchar) cc from x group by all")
sparql("group_concat_distinct", f'SELECT ?w (GROUP_CONCAT(DISTINCT ?v; separator="|") AS ?cc) WHERE {{ {SENSOR} {READ} }} GROUP BY ?w', f"{_SR} select w, string_agg(distinct v::varchar, '|' order by v::varchar) cc from x group by w")
sparql("sample_value", f"SELECT ?w (SAMPLE(?s) AS ?one) WHERE {{ {SENSOR} }} GROUP BY ?w", f"{_SR} select w, min(s) one from w group by w")


@query(f"{_SR} select w, count(v) n, string_agg(v::varchar, ',' order by t, v) vs from x group by w")
def nest_aggregation(spark: SparkSession, d: str) -> DataFrame:
    q = f"SELECT ?w (otit:nestAggregation(?v) AS ?all) WHERE {{ {SENSOR} {READ} }} GROUP BY ?w"
    return engine(spark, d).execute_hybrid_query(HEAD + q).select("w", F.size("all").cast("bigint").alias("n"), F.array_join("all", ",").alias("vs"))


sparql("subselect_join", f"SELECT ?w ?s ?m WHERE {{ {SENSOR} {{ SELECT ?w (MAX(?v) AS ?m) WHERE {{ {SENSOR} {READ} }} GROUP BY ?w }} }}", f"{_SR}, y as (select w, max(v) m from x group by w) select w.w, w.s, m from w join y on w.w = y.w")

# optional, negation, union ------------------------------------------------------------------------

sparql("optional_left", "SELECT ?w ?l ?k WHERE { ?w types:hasSensor ?s OPTIONAL { ?w a types:BigWidget ; rdfs:label ?l . ?s rdfs:label ?k } }", f"with {_E} select a.s w, l.o l, k.o k from e a left join (e b join e l on l.s = b.s and l.p = 'rdfs:label' join e sk on sk.s = b.s and sk.p = 'types:hasSensor' join e k on k.s = sk.o and k.p = 'rdfs:label') on b.s = a.s and b.p = 'rdf:type' and b.o = 'types:BigWidget' and sk.o = a.o where a.p = 'types:hasSensor'")
sparql("optional_filter", 'SELECT ?w ?l WHERE { ?w types:hasSensor ?s OPTIONAL { ?w rdfs:label ?l FILTER(LANG(?l) = "no") } }', f"with {_E} select a.s w, l.o l from e a left join e l on l.s = a.s and l.p = 'rdfs:label' and l.o_lang = 'no' where a.p = 'types:hasSensor'")
sparql("optional_correlated", f"SELECT ?s ?v ?greater WHERE {{ {SENSOR} {READ} OPTIONAL {{ BIND(?v > 5000 AS ?greater) FILTER(?greater) }} }}", f"{_SR} select s, v, case when v > 5000 then true end greater from x")
sparql("optional_range", f"""SELECT ?s ?a ?b WHERE {{ {SENSOR} {READ} BIND({SECONDS} AS ?a)
    OPTIONAL {{ ?s otit:hasTimeseries ?ts9 . ?ts9 otit:hasDataPoint ?dp2 . ?dp2 otit:hasTimestamp ?t2 ; otit:hasValue ?v2 . BIND(otit:DateTimeAsSeconds(?t2) AS ?b) FILTER(?b > ?a && ?b <= ?a + 900 && ?v2 > ?v) }} }}""",
    f"{_SR} select a.s, a.us // 1000000 a, b.us // 1000000 b from x a left join x b on a.w = b.w and a.s = b.s and b.us // 1000000 > a.us // 1000000 and b.us // 1000000 <= a.us // 1000000 + 900 and b.v > a.v")
sparql("minus_anti", "SELECT ?w ?s WHERE { ?w types:hasSensor ?s MINUS { ?w a types:BigWidget } }", f"with {_E} select s w, o s from e where p = 'types:hasSensor' and s not in (select s from e where p = 'rdf:type' and o = 'types:BigWidget')")
sparql("minus_data_points", f"SELECT ?s ?v WHERE {{ {SENSOR} ?ts otit:hasDataPoint ?dp . ?dp otit:hasValue ?v MINUS {{ ?ts otit:hasDataPoint ?dp . ?dp otit:hasValue ?v FILTER(?v > 300) }} }}", f"{_SR} select s, v from x where v <= 300")
sparql("exists_semi", f"SELECT ?w ?s WHERE {{ ?w types:hasSensor ?s FILTER EXISTS {{ SELECT ?s WHERE {{ ?s otit:hasTimeseries ?ts . {READ} FILTER(?v > 100000) }} }} }}", f"{_SR} select distinct w, s from x where v > 100000")
sparql("not_exists_anti", f"SELECT ?w ?s WHERE {{ ?w types:hasSensor ?s FILTER NOT EXISTS {{ ?s otit:hasTimeseries ?ts . {READ} FILTER(?v > 100000) }} }}", f"{_SR} select w, s from w where s not in (select s from x where v > 100000)")
sparql("not_exists_aggregated", f"SELECT ?w ?s WHERE {{ ?w types:hasSensor ?s FILTER NOT EXISTS {{ SELECT ?s WHERE {{ ?s otit:hasTimeseries ?ts . {READ} }} GROUP BY ?s HAVING (SUM(?v) <= 1000000) }} }}", f"{_SR} select w, s from w where s not in (select s from x group by s having sum(v) <= 1000000)")
sparql("exists_or_projected", "SELECT ?w (EXISTS {?w a types:BigWidget} AS ?big) WHERE { ?w types:hasSensor ?s FILTER(?s = case:sensor1 || EXISTS {?w a types:BigWidget}) }", f"with {_E}, b as (select s from e where p = 'rdf:type' and o = 'types:BigWidget') select s w, s in (from b) big from e where p = 'types:hasSensor' and (o = 'case:sensor1' or s in (from b))")
# variables that may be unbound on either side
_BIG = "big as (select a.s w, l.o l from e a join e l on l.s = a.s and l.p = 'rdfs:label' where a.p = 'rdf:type' and a.o = 'types:BigWidget'), en as (select l.s w, l.o l from e l where l.p = 'rdfs:label' and l.o_lang = 'en'), se as (select s w, o s from e where p = 'types:hasSensor')"
_ENGLISH = 'OPTIONAL { ?w a types:BigWidget ; rdfs:label ?l FILTER(LANG(?l) = "en") }'
_MAYBE = f"{_BIG}, a as (select se.w, s, b.l from se left join (select big.* from big join en using (w, l)) b using (w))"
sparql("join_unbound", f"SELECT ?w ?s ?l WHERE {{ {{ ?w types:hasSensor ?s }} {{ ?w rdfs:label ?l FILTER(LANG(?l) = 'no') }} {{ ?w types:hasSensor ?s {_ENGLISH.replace('en', 'no')} }} }}", f"with {_E}, {_BIG}, no as (select s w, o l from e where p = 'rdfs:label' and o_lang = 'no') select w, s, l from se join no using (w)")
sparql("optional_unbound", f"SELECT ?w ?l ?k WHERE {{ {{ SELECT DISTINCT ?w ?l WHERE {{ ?w rdfs:label ?l FILTER(STRSTARTS(?l, 'widget')) }} }} OPTIONAL {{ {{ ?w types:hasSensor ?k }} UNION {{ ?w a ?k . ?w rdfs:label ?l }} }} }}", f"with {_E}, a as (select distinct s w, o l from e where p = 'rdfs:label' and o like 'widget%') select a.w, a.l, k.k from a left join (select s w, o k from e where p = 'types:hasSensor' union all select x.s, x.o from e x join a on a.w = x.s where x.p = 'rdf:type') k using (w)")
sparql("minus_unbound", f"SELECT ?w ?s ?l WHERE {{ ?w types:hasSensor ?s {_ENGLISH} MINUS {{ {{ ?w a types:BigWidget ; rdfs:label ?l }} UNION {{ ?x a rds:Site ; rdfs:label ?l }} UNION {{ ?w types:hasSensor case:sensor1 }} }} }}", f"with {_E}, {_MAYBE} select w, s, l from a where l is null and w not in (select w from se where s = 'case:sensor1')")
sparql("exists_unbound", f"SELECT ?w ?s ?l WHERE {{ ?w types:hasSensor ?s {_ENGLISH} FILTER EXISTS {{ {{ ?w a types:SmallWidget }} UNION {{ ?w a types:BigWidget ; rdfs:label ?l FILTER(CONTAINS(?l, '2')) }} }} }}", f"with {_E}, {_MAYBE} select w, s, l from a where l like '%2%' or w in (select s from e where p = 'rdf:type' and o = 'types:SmallWidget')")
sparql("union_bag", "SELECT ?x WHERE { { ?x a types:BigWidget } UNION { ?x types:hasSensor ?s } UNION { ?x a rds:Site } }", f"with {_E} select s x from e where (p = 'rdf:type' and o in ('types:BigWidget', 'rds:Site')) or p = 'types:hasSensor'")
sparql("distinct_rows", f"SELECT DISTINCT ?wtur ?v WHERE {{ {PRODUCTION} {READ} }}", f"{_PR} select distinct wtur, v from x")
sparql("values_join", "SELECT ?w ?s ?n WHERE { ?w types:hasSensor ?s VALUES (?w ?n) { (case:widget1 1) (case:widget2 2) (UNDEF 3) } }", f"with {_E} select s w, o s, n from e, (values ('case:widget1', 1), ('case:widget2', 2), (null, 3)) x(k, n) where p = 'types:hasSensor' and (k = s or k is null)")

# expressions --------------------------------------------------------------------------------------

sparql("in_filter", f"SELECT ?s ?v WHERE {{ {SENSOR} {READ} FILTER(?v IN ((300+4), 500, 612) || ?s NOT IN (case:sensor1, case:sensor2)) FILTER(?v < 1000) }}", f"{_SR} select s, v from x where (v in (304, 500, 612) or s not in ('case:sensor1', 'case:sensor2')) and v < 1000")
sparql("not_equal", f"SELECT ?s ?v WHERE {{ {SENSOR} {READ} FILTER(?v != 500 && ?s != case:sensor1) }}", f"{_SR} select s, v from x where v <> 500 and s <> 'case:sensor1'")
sparql("hash_funcs", 'SELECT ?l (MD5(?l) AS ?a) (SHA1(?l) AS ?b) (SHA256(?l) AS ?c) (ENCODE_FOR_URI(?l) AS ?d) (LANGMATCHES(LANG(?l), "EN") AS ?e) WHERE { ?w rdfs:label ?l }', f"with {_E} select o l, md5(o) a, sha1(o) b, sha256(o) c, url_encode(o) d, coalesce(lower(o_lang) = 'en' or lower(o_lang) like 'en-%', false) e from e where p = 'rdfs:label'")
sparql("term_funcs", 'SELECT ?l (IRI(CONCAT("urn:x#", STR(?k))) AS ?a) (STRDT(?k, xsd:integer) + 1 AS ?b) (LANG(?m) AS ?c) (STRLEN(STR(UUID())) AS ?d) (STRLEN(STRUUID()) AS ?e) (isBlank(?n) AS ?f) (TIMEZONE(xsd:dateTime("2022-01-01T00:00:00Z")) AS ?g) WHERE { ?w a types:BigWidget ; rdfs:label ?l BIND(STRAFTER(?l, " ") AS ?k) BIND(STRLANG(?l, "nb") AS ?m) BIND(BNODE(?k) AS ?n) }', f"with {_E} select l.o l, 'urn:x#' || split_part(l.o, ' ', 2) a, split_part(l.o, ' ', 2)::bigint + 1 b, 'nb' c, 45 d, 36 e, true f, 'PT0S' g from e a join e l on l.s = a.s and l.p = 'rdfs:label' where a.p = 'rdf:type' and a.o = 'types:BigWidget'")
sparql("if_expr", f"SELECT ?s (IF(?v > 5000, ?v, 5000) AS ?x) WHERE {{ {SENSOR} {READ} }}", f"{_SR} select s, greatest(v, 5000) x from x")
sparql("coalesce_bound", "SELECT ?w ?b (COALESCE(?l, ?w) AS ?c) WHERE { ?w types:hasSensor ?s OPTIONAL { ?w a types:BigWidget ; rdfs:label ?l FILTER(LANG(?l) = 'en') } BIND(BOUND(?l) AS ?b) }", f"with {_E} select a.s w, l.o is not null b, coalesce(l.o, a.s) c from e a left join (e b join e l on l.s = b.s and l.p = 'rdfs:label' and l.o_lang = 'en' and b.p = 'rdf:type' and b.o = 'types:BigWidget') on b.s = a.s where a.p = 'types:hasSensor'")
sparql("math_funcs", f"SELECT ?s ?v (ABS(-?v) AS ?a) (CEIL(?v / 7.0) AS ?b) (FLOOR(?v / 7.0) AS ?c) (ROUND(?v / 8.0) AS ?d) ((?v + 3) * 2 - 1 AS ?e) (?v / 0 AS ?f) WHERE {{ {SENSOR} {READ} }}", f"{_SR} select s, v, abs(-v) a, ceil(v / 7.0::double) b, floor(v / 7.0::double) c, floor(v / 8.0::double + 0.5) d, (v + 3) * 2 - 1 e, null::double f from x")
sparql("concat_cast", f'SELECT (CONCAT(STR(?s), "-", ?v) AS ?a) (xsd:string(?v) AS ?b) (xsd:integer(STR(?v)) AS ?c) (xsd:double(?v) AS ?d) WHERE {{ {SENSOR} {READ} }}', f"{_SR} select s || '-' || v a, v::varchar b, v c, v::double d from x")
sparql("string_funcs", 'SELECT ?l (STRLEN(?l) AS ?n) (UCASE(?l) AS ?u) (SUBSTR(?l, 2, 3) AS ?b) (STRBEFORE(?l, " ") AS ?x) (STRAFTER(?l, " ") AS ?y) (CONTAINS(?l, "1") AS ?k) (REPLACE(?l, "[0-9]+", "#") AS ?r) WHERE { ?w rdfs:label ?l FILTER(REGEX(?l, "^WIDGET", "i")) }', f"with {_E} select o l, length(o) n, upper(o) u, substr(o, 2, 3) b, split_part(o, ' ', 1) x, split_part(o, ' ', 2) y, contains(o, '1') k, regexp_replace(o, '[0-9]+', '#', 'g') r from e where p = 'rdfs:label' and o ilike 'widget%'")
sparql("lang_datatype", "SELECT ?w ?l (LANG(?l) AS ?g) (DATATYPE(?l) AS ?d) (isLiteral(?l) AS ?k) (isIRI(?w) AS ?i) WHERE { ?w a types:SmallWidget ; rdfs:label ?l }", f"with {_E} select l.s w, l.o l, coalesce(l.o_lang, '') g, l.o_dt d, true k, true i from e a join e l on l.s = a.s and l.p = 'rdfs:label' where a.p = 'rdf:type' and a.o = 'types:SmallWidget'")
sparql("datetime_funcs", f"SELECT ?s (year(?t) AS ?y) (month(?t) AS ?m) (day(?t) AS ?d) (hours(?t) AS ?h) (minutes(?t) AS ?mi) (seconds(?t) AS ?se) WHERE {{ {SENSOR} {READ} }}", f"{_SR} select s, year(t) y, month(t) m, day(t) d, hour(t) h, minute(t) mi, second(t)::bigint se from x")
sparql("epoch_functions", f"SELECT ?s ({SECONDS} AS ?a) (otit:DateTimeAsNanos(?t) AS ?b) ({SECONDS.replace('?t', 'otit:SecondsAsDateTime(60)')} AS ?c) (otit:DateTimeAsNanos(otit:NanosAsDateTime(1500)) AS ?d) WHERE {{ {SENSOR} {READ} }}", f"{_SR} select s, us // 1000000 a, us * 1000 b, 60 c, 1000 d from x")
sparql("like_function", 'SELECT ?l WHERE { ?x rdfs:label ?l FILTER(otit:like(?l, "A1%")) }', f"with {_E} select o l from e where p = 'rdfs:label' and o like 'A1%'")
sparql("same_term", "SELECT ?a ?b WHERE { ?w types:hasSensor ?a, ?b FILTER(!sameTerm(?a, ?b)) }", f"with {_E} select x.o a, y.o b from e x join e y on x.s = y.s and x.p = 'types:hasSensor' and y.p = x.p where x.o <> y.o")
sparql("order_limit_offset", f"SELECT ?s ?v ?x WHERE {{ {SENSOR} {READ} BIND({SECONDS} AS ?x) }} ORDER BY DESC(?v) ?s ?x LIMIT 20 OFFSET 5", f"{_SR} select s, v, us // 1000000 x from x order by v desc, s, x limit 20 offset 5")

# paths --------------------------------------------------------------------------------------------

sparql("path_sequence", "SELECT ?w (MAX(?v) AS ?m) WHERE { ?w types:hasSensor/otit:hasTimeseries/otit:hasDataPoint/otit:hasValue ?v } GROUP BY ?w", f"{_SR} select w, max(v) m from x group by w")
sparql("path_inverse_alt", "SELECT ?a ?b WHERE { ?a ^types:hasSensor|otit:hasTimeseries ?b FILTER(STRSTARTS(?a, 'case:')) }", f"with {_E} select o a, s b from e where p = 'types:hasSensor' union all select s, o from e where p = 'otit:hasTimeseries' and s like 'case:%'")
_STEP = "step as (select distinct a.s, n.s o from e a join e n on n.o = a.o and n.p = 'rds:hasFunctionalAspectNode' where a.p = 'rds:hasFunctionalAspect')"
sparql("path_plus", "SELECT ?a ?b WHERE { ?a a rds:Site . ?a (rds:hasFunctionalAspect/^rds:hasFunctionalAspectNode)+ ?b }", f"with recursive {_E}, {_STEP}, c as (select s, o from step union select c.s, step.o from c join step on step.s = c.o) select distinct c.s a, c.o b from c join e k on k.s = c.s and k.p = 'rdf:type' and k.o = 'rds:Site'")
sparql("path_star_from_start", "SELECT ?b WHERE { wp:Site1 (rds:hasFunctionalAspect/^rds:hasFunctionalAspectNode)* ?b }", f"with recursive {_E}, {_STEP}, c as (select 'wp:Site1' o union select step.o from c join step on step.s = c.o) select distinct o b from c")
sparql("path_optional_negated", "SELECT ?a ?b ?c WHERE { ?a a types:BigWidget . ?a types:hasSensor? ?b . ?a !(rdf:type|rdfs:label) ?c }", f"with {_E}, w as (select s a from e where p = 'rdf:type' and o = 'types:BigWidget') select w.a, b.o b, c.o c from w join (select s, o from e where p = 'types:hasSensor' union select s, s from e) b on b.s = w.a join e c on c.s = w.a and c.p not in ('rdf:type', 'rdfs:label')")

# other tables as graph and series -----------------------------------------------------------------


def star_engine(spark: SparkSession, d: str) -> Engine:
    """Customers and nations as a graph, made by the mapper; the events of a customer are a series."""
    store = _store(spark, d, lambda: TripleStore(_star_triples(spark, d)), "star")
    return Engine(store).set_time_series(FrameSource(table(spark, d, "events"), "user_id", "ts", "value"))


def _star_triples(spark: SparkSession, d: str) -> DataFrame:
    m = Mapping(STAR, spark)
    m.expand("ex:Nation", table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("Key"), F.concat(F.lit("urn:ex#nation"), "n_nationkey").alias("nation"), F.col("n_name").alias("name")), validate=False)
    c = table(spark, d, "customer")
    iri = lambda kind, key: F.concat(F.lit(f"urn:ex#{kind}"), key)
    m.expand("ex:Customer", c.select(F.col("c_custkey").cast("string").alias("Key"), iri("customer", "c_custkey").alias("customer"), iri("series", "c_custkey").alias("series"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), iri("nation", "c_nationkey").alias("nation")), validate=False)
    return m.triples()


STAR = """@prefix ex: <urn:ex#> . @prefix ts: <urn:tidegraph:series#> .
ex:Nation [xsd:anyURI ?nation, xsd:string ?name] :: { ottr:Triple(?nation, rdf:type, ex:Nation), ottr:Triple(?nation, ex:name, ?name) } .
ex:Customer [xsd:anyURI ?customer, xsd:anyURI ?series, xsd:string ?id, xsd:string ?name, xsd:string ?segment, xsd:anyURI ?nation] :: {
  ottr:Triple(?customer, ex:name, ?name), ottr:Triple(?nation, ex:hasCustomer, ?customer),
  ottr:Triple(?customer, rdf:type, ex:Customer), ottr:Triple(?customer, ex:segment, ?segment), ottr:Triple(?customer, ex:inNation, ?nation),
  ottr:Triple(?customer, ts:hasTimeseries, ?series), ottr:Triple(?series, ts:hasExternalId, ?id), ottr:Triple(?series, ts:hasDatatype, xsd:double) } .
ottr:Triple(ex:Nation, ex:name, "Nation") . ottr:Triple(ex:Customer, ex:name, "Customer") ."""


@query("select n_name name, c_mktsegment segment, count(*) n, round(sum(value), 2) total from events join customer on user_id = c_custkey join nation on c_nationkey = n_nationkey where epoch_us(ts) >= 1704844800000000 group by all")
def star_schema_series(spark: SparkSession, d: str) -> DataFrame:
    q = """PREFIX ex: <urn:ex#> PREFIX ts: <urn:tidegraph:series#> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
    SELECT ?name ?segment (COUNT(*) AS ?n) (SUM(?v) AS ?sum) WHERE { ?c a ex:Customer ; ex:segment ?segment ; ex:inNation/ex:name ?name ; ts:hasTimeseries/ts:hasDataPoint ?dp . ?dp ts:hasTimestamp ?t ; ts:hasValue ?v
    FILTER(?t >= "2024-01-10T00:00:00Z"^^xsd:dateTime) } GROUP BY ?name ?segment"""
    return star_engine(spark, d).execute_hybrid_query(q).select("name", "segment", "n", F.round("sum", 2).alias("total"))


_days: dict[tuple[str, str], str] = {}


def partitioned_engine(spark: SparkSession, d: str) -> Engine:
    """The readings of ``ts`` as a table on storage, partitioned by year, month and day; it is written once in an application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _days:
        ts = table(spark, d, "ts").withColumns({"y": F.year("ts"), "m": F.month("ts"), "d": F.dayofmonth("ts")}).repartitionByRange("ts", "id")
        _days[key] = Spool(spark).write(ts, by=["y", "m", "d"])[1]
    kept = TimeSeriesTable(XSD + "int", path=_days[key], timestamp_column="ts", value_column="v", year_column="y", month_column="m", day_column="d")
    return engine(spark, d).set_time_series(TableSource(spark, [kept]))


@query(f"{_PR} select wtur, count(*) n from x where us >= 1642896000000000 and us < 1643068800000000 group by wtur")
def partition_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Bounds on the time are bounds on the partition columns: only the folders of these days are read."""
    q = f'SELECT ?wtur (COUNT(*) AS ?n) WHERE {{ {PRODUCTION} {READ} FILTER(?t >= "2022-01-23T00:00:00Z"^^xsd:dateTime && ?t < "2022-01-25T00:00:00Z"^^xsd:dateTime) }} GROUP BY ?wtur'
    return partitioned_engine(spark, d).execute_hybrid_query(HEAD + q)


@query(f"{_PR}, c as (select wtur, count(*) n from x group by wtur) select wtur, us // 1000000 as seconds, v, n from x join c using (wtur) where us >= 1642896000000000 and us < 1643068800000000")
def partition_scope(spark: SparkSession, d: str) -> DataFrame:
    """The bounds outside do not reach into a sub-select that counts readings of all times."""
    q = f"""SELECT ?wtur ?seconds ?v ?n WHERE {{ {PRODUCTION} {READ} BIND({SECONDS} AS ?seconds) {{ SELECT ?wtur (COUNT(?v) AS ?n) WHERE {{ {PRODUCTION} {READ} }} GROUP BY ?wtur }}
    FILTER(?t >= "2022-01-23T00:00:00Z"^^xsd:dateTime && ?t < "2022-01-25T00:00:00Z"^^xsd:dateTime) }}"""
    return partitioned_engine(spark, d).execute_hybrid_query(HEAD + q)


def _history(spark: SparkSession, d: str) -> HistorySource:
    """The readings of ``ts1`` behind a history service's two ways of reading: raw, and aggregates of intervals."""
    rows = table(spark, d, "ts1").where("id is not null and timestamp is not null and value is not null")

    def read(start: datetime | None, end: datetime | None) -> DataFrame:
        out = rows if start is None else rows.where(F.col("timestamp") >= F.lit(start))
        return out if end is None else out.where(F.col("timestamp") < F.lit(end))

    def processed(start: datetime | None, end: datetime | None, aggregate: str, seconds: int) -> DataFrame:
        at = F.timestamp_seconds(F.floor(F.unix_seconds("timestamp") / seconds) * seconds)
        return read(start, end).groupBy("id", at.alias("timestamp")).agg(F.expr(f"{aggregate}(value)").alias("value"))

    return HistorySource(read, processed)


@query(f"{_SR} select w, us // 600000000 period, sum(v)::bigint total from x where us >= 1640995200000000 group by all")
def history_processed(spark: SparkSession, d: str) -> DataFrame:
    """Sums of ten minutes are handed to the service, those of a widget's sensors are added up here."""
    q = f'SELECT ?w ?period (SUM(?v) AS ?total) WHERE {{ {SENSOR} {READ} BIND(xsd:integer(FLOOR({SECONDS} / 600.0)) AS ?period) FILTER(?t >= "2022-01-01T00:00:00Z"^^xsd:dateTime) }} GROUP BY ?w ?period'
    return engine(spark, d).set_time_series(_history(spark, d)).execute_hybrid_query(HEAD + q)


@query(f"{_SR} select w, us // 600000000 period, avg(v) mean from x where us > 1641016800000000 and us <= 1641276000000000 group by all")
def history_raw(spark: SparkSession, d: str) -> DataFrame:
    """Bounds that do not lie on periods, and means, need the readings themselves, from within the bounds alone."""
    q = f"""SELECT ?w ?period (AVG(?v) AS ?mean) WHERE {{ {SENSOR} {READ} BIND(xsd:integer(FLOOR({SECONDS} / 600.0)) AS ?period)
    FILTER(?t > "2022-01-01T06:00:00Z"^^xsd:dateTime && ?t <= "2022-01-04T06:00:00Z"^^xsd:dateTime) }} GROUP BY ?w ?period"""
    return engine(spark, d).set_time_series(_history(spark, d)).execute_hybrid_query(HEAD + q)


@query(f"{_SR} select w, count(*) n, sum(v)::bigint total from x where us >= 1640995200000000 group by w")
def csv_series(spark: SparkSession, d: str) -> DataFrame:
    """Readings of ``ts1`` from CSV files."""
    rows = table(spark, d, "ts1").withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    path = f"{Spool(spark).root}/csv"
    rows.write.csv(path, header=True)
    source = TableSource(spark, [TimeSeriesTable(XSD + "long", path=path, format="csv", options={"header": "true", "inferSchema": "true"})])
    q = f'SELECT ?w (COUNT(*) AS ?n) (SUM(?v) AS ?total) WHERE {{ {SENSOR} {READ} FILTER(?t >= "2022-01-01T00:00:00Z"^^xsd:dateTime) }} GROUP BY ?w'
    return engine(spark, d).set_time_series(source).execute_hybrid_query(HEAD + q)


@query(f"{_PR} select site_label, count(*) n, max(v) most from x where us >= 1640995200000000 group by 1")
def stream_of_readings(spark: SparkSession, d: str) -> DataFrame:
    """The same kind of query over a stream of readings joined with the static graph."""
    schema = table(spark, d, "ts").schema
    source = FrameSource(readings_stream(spark, f"{d}/ts.parquet", schema), timestamp="ts", value="v")
    q = f'SELECT ?site_label (COUNT(*) AS ?n) (MAX(?v) AS ?most) WHERE {{ {PRODUCTION} {READ} FILTER(?t >= "2022-01-01T00:00:00Z"^^xsd:dateTime) }} GROUP BY ?site_label'
    return run_available(engine(spark, d).set_time_series(source).execute_hybrid_query(HEAD + q))


# path language ------------------------------------------------------------------------------------

_DSL = "with d as (select n_name nation, n_name || '.' || c_name path, epoch_us(ts) us, value v from events join customer on user_id = c_custkey join nation on c_nationkey = n_nationkey)"


def _dsl(spark: SparkSession, d: str, text: str) -> DataFrame:
    return star_engine(spark, d).name_predicate("urn:ex#name").connective_mapping({".": "urn:ex#hasCustomer"}).execute_dsl_query(text)


@query(f"{_DSL} select path, us // 3600000000 * 3600 as start, round(avg(v), 6) mean from d where us between 1704844800000000 and 1705017600000000 group by all")
def dsl_mean_bucket(spark: SparkSession, d: str) -> DataFrame:
    df = _dsl(spark, d, "Nation.[c]Customer\nfrom 2024-01-10T00:00:00+00:00\nto 2024-01-12T00:00:00+00:00\naggregate mean 1h")
    return df.select(F.col("c_path_name").alias("path"), F.unix_seconds("timestamp").alias("start"), F.round("c_timeseries_datapoint_value", 6).alias("mean"))


@query(f"{_DSL} select nation path, us, count(*) n, round(sum(v), 6) total from d where v > 50 group by all")
def dsl_group_nest(spark: SparkSession, d: str) -> DataFrame:
    df = _dsl(spark, d, "[n]Nation.[c]Customer > 50.0\ngroup n")
    values = F.col("c_timeseries_datapoint_value")
    return df.select(F.col("n_path_name").alias("path"), F.unix_micros("timestamp").alias("us"), F.size(values).cast("bigint").alias("n"), F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# customers with three meters, whose readings are of three datatypes: amount (double), number (long) and kind (string)
_METERS = """@prefix ex: <urn:ex#> . @prefix ts: <urn:tidegraph:series#> .
ex:Meter [xsd:anyURI ?customer, xsd:anyURI ?meter, xsd:string ?name, xsd:string ?of, xsd:anyURI ?datatype, xsd:string ?id] :: {
  ottr:Triple(?customer, ex:kind, "Customer"), ottr:Triple(?customer, ex:name, ?of), ottr:Triple(?customer, ex:hasMeter, ?meter), ottr:Triple(?meter, ex:name, ?name),
  ottr:Triple(?meter, ts:hasTimeseries, ?meter), ottr:Triple(?meter, ts:hasExternalId, ?id), ottr:Triple(?meter, ts:hasDatatype, ?datatype) } ."""


def _meter_triples(spark: SparkSession, d: str) -> DataFrame:
    m = Mapping(_METERS, spark)
    users = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("of"))
    for name, kind in (("amount", "double"), ("number", "long"), ("kind", "string")):
        row = users.select(F.concat(F.lit(name), "id").alias("Key"), F.concat(F.lit("urn:ex#customer"), "id").alias("customer"), F.concat(F.lit(f"urn:ex#{name}"), "id").alias("meter"), F.lit(name).alias("name"), "of", F.lit(XSD + kind).alias("datatype"), "id")
        m.expand("ex:Meter", row, validate=False)
    return m.triples()


def _meters(spark: SparkSession, d: str, text: str) -> DataFrame:
    """A query of the path language with own templates for names and types: a type is a literal of the element itself."""
    store = _store(spark, d, lambda: TripleStore(_meter_triples(spark, d)), "meters")
    events = table(spark, d, "events").withColumn("user_id", F.col("user_id").cast("string"))
    tables = [TimeSeriesTable(XSD + kind, events, identifier_column="user_id", timestamp_column="ts", value_column=c) for kind, c in (("double", "value"), ("long", "event_id"), ("string", "event_type"))]
    e = Engine(store).set_time_series(TableSource(spark, tables)).connective_mapping({".": "urn:ex#hasMeter"})
    e.templates([("element", Iri("urn:ex#name"), "name")], [("element", Iri("urn:ex#kind"), "name")])
    return e.execute_dsl_query(text)


_ME = "with m as (select c_name || '.' p, epoch_us(ts) us, value amount, event_id number, event_type kind from events join customer on user_id = c_custkey)"


@query(f"{_ME} select a.p || 'amount' path, a.us, a.amount, b.number from m a join m b on a.p = b.p and a.us = b.us where a.amount >= 20 and b.number < 900")
def dsl_two_paths(spark: SparkSession, d: str) -> DataFrame:
    """Two paths of one element share their timestamp."""
    df = _meters(spark, d, '[c]Customer."amount" >= 20.0\n[c]."number" < 900')
    return df.select(F.col("c_amount__path_name").alias("path"), F.unix_micros("timestamp").alias("us"), F.col("c_amount__timeseries_datapoint_value").alias("amount"), F.col("c_number__timeseries_datapoint_value").alias("number"))


@query(f"{_ME} select a.p || 'amount' path, a.us, a.amount, b.kind from m a left join m b on a.p = b.p and a.us = b.us and b.kind <> 'click' where a.amount <= 5")
def dsl_optional(spark: SparkSession, d: str) -> DataFrame:
    """An optional path, with a condition of its own, takes no row away."""
    df = _meters(spark, d, '[c]Customer."amount" <= 5.0\n[c]."kind"? != "click"')
    return df.select(F.col("c_amount__path_name").alias("path"), F.unix_micros("timestamp").alias("us"), F.col("c_amount__timeseries_datapoint_value").alias("amount"), F.col("c_kind__timeseries_datapoint_value").alias("kind"))


@query(f"{_ME} select p || 'kind' path, us, kind, amount from m where kind like 'p%' and amount < number")
def dsl_operators(spark: SparkSession, d: str) -> DataFrame:
    """A pattern of text, and a path held against a path."""
    df = _meters(spark, d, '[c]Customer."kind" like "p%"\n[c]."amount" < [c]."number"')
    return df.select(F.col("c_kind__path_name").alias("path"), F.unix_micros("timestamp").alias("us"), F.col("c_kind__timeseries_datapoint_value").alias("kind"), F.col("c_amount__timeseries_datapoint_value").alias("amount"))


@query(f"{_ME} select p || 'kind' path, us // 500000 * 500000 us, max(kind) kind from m where kind = 'error' group by all")
def dsl_half_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Periods that are no whole seconds."""
    df = _meters(spark, d, 'Customer."kind" = "error"\naggregate max 500ms')
    return df.select(F.col("Customer_kind__path_name").alias("path"), F.unix_micros("timestamp").alias("us"), F.col("Customer_kind__timeseries_datapoint_value").alias("kind"))


# mapper -------------------------------------------------------------------------------------------

_TEMPLATES = """@prefix ex: <urn:ex#> .
ex:Sensor [xsd:anyURI ?sensor, xsd:string ?unit, xsd:long ?low, ?high] :: { ottr:Triple(?sensor, ex:unit, ?unit), ex:Range(?sensor, ?low, ?high) } .
ex:Range [xsd:anyURI ?x, ?low, ?high] :: { ottr:Triple(?x, ex:low, ?low), ottr:Triple(?x, ex:high, ?high), ottr:Triple(?x, rdf:type, ex:Bounded) } .
ex:Minted [xsd:anyURI ?node, xsd:string ?name] :: { ottr:Triple(?node, ex:name, ?name) } .
ex:Refers [xsd:anyURI ?x, ? xsd:anyURI ?node] :: { ottr:Triple(?x, ex:refers, ?node) } .
ex:Cross [xsd:anyURI ?x, List<xsd:long> ?a, List<xsd:long> ?b] :: { cross | ex:Two(?x, ++?a, ++?b) } .
ex:Min [xsd:anyURI ?x, List<xsd:long> ?a, List<xsd:long> ?b] :: { zipMin | ex:Two(?x, ++?a, ++?b) } .
ex:Max [xsd:anyURI ?x, List<xsd:long> ?a, List<xsd:long> ?b] :: { zipMax | ex:Two(?x, ++?a, ++?b) } .
ex:Listed [xsd:anyURI ?x, List<xsd:anyURI> ?nodes] :: { cross | ottr:Triple(?x, ex:node, ++?nodes) } .
ex:Named [xsd:anyURI ?x, ?name] :: { ottr:Triple(?x, ex:name, ?name), ottr:Triple(?x, ex:note, "fixed"@nb-NO) } .
ex:Times [xsd:anyURI ?x, ?here, ?there] :: { ottr:Triple(?x, ex:here, ?here), ottr:Triple(?x, ex:there, ?there) } .
ex:Sized [xsd:anyURI ?x, List<xsd:long> ?a, List<xsd:anyURI> ?nodes] :: { zipMax | ex:Item(++?nodes, ++?a) } .
ex:Item [xsd:anyURI ?node, xsd:long ?a] :: { ottr:Triple(?node, ex:a, ?a) } .
ex:Two [xsd:anyURI ?x, ? xsd:long ?a, ? xsd:long ?b] :: { ottr:Triple(?x, ex:a, ?a), ottr:Triple(?x, ex:b, ?b) } ."""
_X = "http://www.w3.org/2001/XMLSchema#"


def _plain(df: DataFrame) -> DataFrame:
    return df.select("s", "p", "o", "o_kind", F.coalesce("o_dt", F.lit("")).alias("dt"))


def _sensor_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sensors").select(F.col("id").alias("Key"), F.concat(F.lit("urn:ex#"), "id").alias("sensor"), "unit", F.col("phys_min").alias("low"), F.col("phys_max").alias("high"))


@query(f"""with x as (select 'urn:ex#' || id s, * exclude (id) from sensors) select s, 'urn:ex#unit' p, unit o, 'literal' o_kind, '{_X}string' dt from x
union all select s, 'urn:ex#low', phys_min::varchar, 'literal', '{_X}long' from x union all select s, 'urn:ex#high', phys_max::varchar, 'literal', '{_X}long' from x
union all select s, '{RDF}type', 'urn:ex#Bounded', 'iri', '' from x""")
def mapper_expand(spark: SparkSession, d: str) -> DataFrame:
    return _plain(Mapping(_TEMPLATES, spark).expand("ex:Sensor", _sensor_rows(spark, d)).triples())


@query("""select '<urn:ex#' || id || '> <urn:ex#unit> "' || unit || '" .' as value from sensors union all
select '<urn:ex#' || id || '> <urn:ex#' || k || '> "' || v || '"^^<http://www.w3.org/2001/XMLSchema#long> .' from (select id, 'low' k, phys_min v from sensors union all select id, 'high', phys_max from sensors) union all
select '<urn:ex#' || id || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <urn:ex#Bounded> .' from sensors""")
def mapper_ntriples(spark: SparkSession, d: str) -> DataFrame:
    return ntriples(Mapping(_TEMPLATES, spark).expand("ex:Sensor", _sensor_rows(spark, d)).triples())


def _minted(spark: SparkSession, d: str) -> Mapping:
    c = table(spark, d, "customer").select(F.format_string("%09d", "c_custkey").alias("Key"), F.col("c_name").alias("name"))
    return Mapping(_TEMPLATES, spark).expand("ex:Minted", c, mint_iris={"node": MintingOptions("urn:ex#node", 3)})


@query(f"select 'urn:ex#node' || (row_number() over (order by c_custkey) + 2) s, 'urn:ex#name' p, c_name o, 'literal' o_kind, '{_X}string' dt from customer")
def mapper_mint(spark: SparkSession, d: str) -> DataFrame:
    return _plain(_minted(spark, d).triples())


@query("with n as (select c_custkey k, 'urn:ex#node' || (row_number() over (order by c_custkey) + 2) node from customer) select 'urn:ex#order' || o_orderkey s, 'urn:ex#refers' p, node o, 'iri' o_kind, '' dt from orders join n on k = o_custkey")
def mapper_resolve(spark: SparkSession, d: str) -> DataFrame:
    m = _minted(spark, d)
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("Key"), F.concat(F.lit("urn:ex#order"), "o_orderkey").alias("x"), F.format_string("%09d", "o_custkey").alias("customer"))
    m.expand("ex:Refers", o, resolve_iris={"node": ResolveIRI("customer", "ex:Minted", "node")}, validate=False)
    return _plain(m.triples().where("p = 'urn:ex#refers'"))


@query("with n as (select c_custkey k, 'urn:ex#node' || (row_number() over (order by c_custkey) + 2) node from customer) select 'urn:ex#order' || o_orderkey s, 'urn:ex#node' p, node o, 'iri' o_kind, '' dt from (select o_orderkey, unnest([o_custkey, o_custkey + 1]) c from orders) join n on k = c")
def mapper_resolve_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of keys become lists of the IRIs minted for them; a key without one gives no triple."""
    m = _minted(spark, d)
    keys = F.array(F.format_string("%09d", "o_custkey"), F.format_string("%09d", F.col("o_custkey") + 1))
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("Key"), F.concat(F.lit("urn:ex#order"), "o_orderkey").alias("x"), keys.alias("customers"))
    m.expand("ex:Listed", o, resolve_iris={"nodes": ResolveIRI("customers", "ex:Minted", "node")}, validate=False)
    return _plain(m.triples().where("p = 'urn:ex#node'"))


@query(f"""with k as (select c_custkey, c_custkey % 4 n, coalesce(sum(c_custkey % 4) over (order by c_custkey rows between unbounded preceding and 1 preceding), 0) ahead from customer),
i as (select c_custkey, ahead, unnest(range(n)) j from k) select 'urn:ex#item' || (5 + ahead + j)::bigint s, 'urn:ex#a' p, (c_custkey + j)::varchar o, 'literal' o_kind, '{_X}long' dt from i""")
def mapper_mint_lists(spark: SparkSession, d: str) -> DataFrame:
    """A list of IRIs is minted for each row, as long as a list that the row has."""
    size, key = (F.col("c_custkey") % 4).cast("int"), F.col("c_custkey")
    a = F.transform(F.slice(F.sequence(F.lit(0), F.lit(3)), F.lit(1), size), lambda j: key + j)
    c = table(spark, d, "customer").select(F.format_string("%09d", key).alias("Key"), F.concat(F.lit("urn:ex#customer"), key).alias("x"), a.alias("a"))
    return _plain(Mapping(_TEMPLATES, spark).expand("ex:Sized", c, mint_iris={"nodes": MintingOptions("urn:ex#item", 5, same_length_as="a")}).triples())


@query(f"select 'urn:ex#nation' || n_nationkey s, 'urn:ex#name' p, n_name o, '{RDF}langString' o_dt, 'en' o_lang from nation union all select 'urn:ex#nation' || n_nationkey, 'urn:ex#note', 'fixed', '{RDF}langString', 'nb-NO' from nation")
def mapper_language_tags(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("Key"), F.concat(F.lit("urn:ex#nation"), "n_nationkey").alias("x"), F.col("n_name").alias("name"))
    return Mapping(_TEMPLATES, spark).expand("ex:Named", n, language_tags={"name": "en"}).triples().select("s", "p", "o", "o_dt", "o_lang")


@query(f"""select 'urn:ex#order' || o_orderkey s, 'urn:ex#here' p, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') o, 'literal' o_kind, '{_X}dateTime' dt from orders
union all select 'urn:ex#order' || o_orderkey, 'urn:ex#there', strftime(o_orderdate + interval 2 hour, '%Y-%m-%dT%H:%M:%S') || '+02:00', 'literal', '{_X}dateTimeStamp' from orders""")
def mapper_time_zones(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("Key"), F.concat(F.lit("urn:ex#order"), "o_orderkey").alias("x"), F.col("o_orderdate").cast("timestamp").alias("here"), F.col("o_orderdate").cast("timestamp").alias("there"))
    return _plain(Mapping(_TEMPLATES, spark).expand("ex:Times", o, time_zones={"there": "Etc/GMT-2"}, validate=False).triples())


def _lists(spark: SparkSession, d: str, template: str) -> DataFrame:
    s = table(spark, d, "sensors").select(F.col("id").alias("Key"), F.concat(F.lit("urn:ex#"), "id").alias("x"), F.array("phys_min", "phys_max").alias("a"), F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"), F.lit(None).cast("bigint")).alias("b"))
    return _plain(Mapping(_TEMPLATES, spark).expand(template, s).triples())


def _lists_sql(rows: str) -> str:
    return f"""with x as (select 'urn:ex#' || id s, phys_min lo, phys_max hi from sensors), y as ({rows})
    select s, 'urn:ex#a' p, a::varchar o, 'literal' o_kind, '{_X}long' dt from y where a is not null union all select s, 'urn:ex#b', b::varchar, 'literal', '{_X}long' from y where b is not null"""


QUERIES["mapper_cross"] = lambda spark, d: _lists(spark, d, "ex:Cross")
SQL["mapper_cross"] = _lists_sql("select s, unnest([lo, hi]) a, b from x, (values (1), (2), (null)) v(b)")
QUERIES["mapper_zip_min"] = lambda spark, d: _lists(spark, d, "ex:Min")
SQL["mapper_zip_min"] = _lists_sql("select s, unnest([lo, hi]) a, unnest([1, 2]) b from x")
QUERIES["mapper_zip_max"] = lambda spark, d: _lists(spark, d, "ex:Max")
SQL["mapper_zip_max"] = _lists_sql("select s, unnest([lo, hi, null]) a, unnest([1, 2, null]) b from x")
