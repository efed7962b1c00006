"""Queries on the operators of this subpackage, over whole tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.leakage import leaked_items
from tidegraph.llm.lookalike import lookalike_classes, lookalike_pairs, unify_text
from tidegraph.llm.packing import pack, vocabulary_count, word_punct_count
from tidegraph.llm.percentiles import cell_percentiles, count_cells, exact_percentiles, merge_cells
from tidegraph.plans.queries import HEAD, PRODUCTION, engine, table
from tidegraph.session import Spool


def _production(spark: SparkSession, d: str) -> DataFrame:
    """The production readings by turbine. The series that the graph names are written first, so that their size decides on a broadcast."""
    series = engine(spark, d).execute_hybrid_query(f"{HEAD} SELECT DISTINCT ?site_label ?wtur_label ?id WHERE {{ {PRODUCTION} ?ts otit:hasExternalId ?id }}")
    named, _ = Spool(spark).write(series)
    return table(spark, d, "ts").select("id", "ts", "v").where("v is not null").join(named, "id")


KEYS = ["site_label", "wtur_label"]
#: A tokenizer file that executors can read.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    q = exact_percentiles(_production(spark, d), KEYS, "v", [0.5, 0.95])
    both = q.groupBy(*KEYS).agg(F.max(F.when(F.col("p") == 0.5, F.col("v"))).alias("median"), F.max(F.when(F.col("p") == 0.95, F.col("v"))).alias("high"))
    return both.where("high >= 3 * median").select(*KEYS)


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return exact_percentiles(_production(spark, d), KEYS, "v", [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]).withColumn("v", F.round("v", 3))


def p4_daily_cells(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles from the counts of separate days; whether they keep the stated bound is told by holding them against the exact ones."""
    rows = _production(spark, d)
    days = count_cells(rows.withColumn("day", F.to_date("ts")), [*KEYS, "day"], "v")
    merged = cell_percentiles(merge_cells(days.drop("day")), [0.5, 0.95])
    exact = exact_percentiles(rows, KEYS, "v", [0.5, 0.95], continuous=False).withColumnRenamed("v", "exact")
    close = F.abs(F.col("v") - F.col("exact")) <= F.abs("exact") * 2**-8
    return merged.join(exact.drop("n"), [*KEYS, "p"]).select(*KEYS, "p", "n", F.col("exact").alias("v"), close.alias("within_bound"))


def _capacity(spark: SparkSession, d: str) -> int:
    return table(spark, d, "packs").where("pack_name = 'short_2k'").first()["capacity"]


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    """Each document's pieces in containers of short_2k."""
    return pack(table(spark, d, "documents"), "doc_id", word_punct_count(F.col("text")), _capacity(spark, d))


def p6_vocabulary(spark: SparkSession, d: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The same with sizes in tokens of a public tokenizer's vocabulary."""
    counted = vocabulary_count(table(spark, d, "documents").select("doc_id", "text"), "text", vocabulary)
    return pack(counted.drop("text"), "doc_id", F.col("tokens"), _capacity(spark, d))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """What any right packing has: every piece once, all tokens, no container over the capacity; and whether at most 2 % are unused beyond the least number of containers."""
    capacity = _capacity(spark, d)
    pieces = p6_pack(spark, d)
    bins = pieces.where("container is not null").groupBy("container").agg(F.sum("piece_size").alias("fill"))
    filled = bins.agg(F.count(F.lit(1)).alias("bins"), F.coalesce(F.max("fill") <= capacity, F.lit(True)).alias("kept_capacity"))
    docs = pieces.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("piece").alias("kinds"), F.max("piece").alias("last"), F.sum("piece_size").alias("size"))
    all_ = docs.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("pieces"), F.sum("size").alias("tokens"), F.coalesce(F.bool_and(F.expr("n = kinds and n = last + 1")), F.lit(True)).alias("each_once"))
    one = all_.unionByName(filled, allowMissingColumns=True)
    one = one.agg(*(F.max(c).alias(c) for c in one.columns))
    return one.select("docs", "pieces", "tokens", "each_once", "kept_capacity", (F.col("bins") <= F.ceil(F.col("tokens") / capacity) * 1.02 + 1).alias("close_to_least"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that packing had to divide: each has exactly one second piece."""
    return p6_pack(spark, d).where("piece = 1").select("doc_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_pairs(table(spark, d, "documents"), "doc_id", "text")


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each document with a text, its class of texts that look alike and the first document with the very same text."""
    return lookalike_classes(table(spark, d, "documents"), "doc_id", "text")


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    forms = unify_text(table(spark, d, "documents").select("doc_id", "text"), "text")
    return forms.select("doc_id", F.sha2("form", 256).alias("form_hash"), F.length("form").cast("bigint").alias("form_chars"))


QUERIES = {f.__name__: f for f in (p4_found, p4_percentiles, p4_daily_cells, p6_found, p6_pack, p6_fill, p6_vocabulary, p7_found, p8_found, p8_classes, p8_forms)}

_PRODUCTION = """
e as (select distinct s, p, o from triples),
m as (select distinct sl.o site_label, wl.o wtur_label, i.o id
    from e st join e sl on sl.s = st.s and sl.p = 'rdfs:label' join e a on a.s = st.s and a.p = 'rds:hasFunctionalAspect'
    join e wl on wl.s = a.o and wl.p = 'rdfs:label' join e t on t.o = a.o and t.p = 'rds:hasFunctionalAspectNode'
    join e ga on ga.s = t.s and ga.p = 'rds:hasFunctionalAspect' join e g on g.o = ga.o and g.p = 'rds:hasFunctionalAspectNode'
    join e na on na.s = g.s and na.p = 'rds:hasFunctionalAspect' join e n on n.o = na.o and n.p = 'rds:hasFunctionalAspectNode'
    join e h on h.s = n.s and h.p = 'otit:hasTimeseries' join e l on l.s = h.o and l.p = 'rdfs:label' and l.o = 'Production'
    join e i on i.s = h.o and i.p = 'otit:hasExternalId'
    where st.p = 'rdf:type' and st.o = 'rds:Site'),
r as (select site_label, wtur_label, v from ts join m using (id) where v is not null)"""

# The form stated anew: widths by their distance in the code charts, blanks and format characters by their class, letters by a list.
_CYRILLIC, _GREEK = ("асԁеһіјӏорԛѕԝхуАВСЕԌНІЈКМОРԚЅТԜХҮУӀёЁїЇ", "acdehijlopqswxyABCEGHIJKMOPQSTWXYYIëËïÏ"), ("οϲϳνΑΒϹΕΗΙͿΚΜΝΟΡΤΧΥΖ", "ocjvABCEHIJKMNOPTXYZ")
_FORMS = rf"""
a as (select doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '\r\n?|[\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), '[\p{{Cf}}\x{{34f}}\x{{180b}}-\x{{180f}}\x{{fe00}}-\x{{fe0f}}]', '', 'g'), '\p{{Zs}}', ' ', 'g') x from documents),
w as (select string_agg(chr(c::int), '' order by c) wide, string_agg(chr((c - 65248)::int), '' order by c) narrow from range(65281, 65375) r(c)),
b as (select doc_id, text, translate(x, wide || 'ｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝｰ｡｢｣､･ﾞﾟ', narrow || 'アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワンー。「」、・゙゚') y from a, w),
c as (select doc_id, text, translate(nfc_normalize(y), '{_CYRILLIC[0]}{_GREEK[0]}', '{_CYRILLIC[1]}{_GREEK[1]}') z from b),
f as (select doc_id, text, nfc_normalize(replace(replace(replace(replace(replace(replace(z, 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ĳ', 'ij')) form from c)"""

# Leaked items told by pairs of neighbouring words in bands of places, where the operator goes by letters and aligns words.
_LEAKS = rf"""with texts as (select 2 * doc_id doc_id, text from documents union all select 2 * item_id + 1, text from benchmark), {_FORMS.replace("from documents)", "from texts)")},
words as (select doc_id, regexp_extract_all(strip_accents(lower(regexp_replace(regexp_replace(regexp_replace(form, '(\x1b|\\+u001b|\\+x1b|\\+033)\[[0-9;]*[A-Za-z]', ' ', 'g'),
    '</?[A-Za-z][A-Za-z0-9]*(\s[^<>]*)?/?>|&[a-z]+;|&#[0-9]+;', ' ', 'g'), '\\+[nrt"]', ' ', 'g'))), '[\p{{L}}\p{{Nd}}]+') w from f where form <> ''),
grams as (select doc_id, len(w) n, unnest(range(1, len(w))) p, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) g from words),
hits as (select d.doc_id // 2 doc_id, i.doc_id // 2 item_id, i.n, i.p, (d.p - i.p + 1000000) // 12 band from grams d join grams i on i.g = d.g and d.doc_id % 2 = 0 and i.doc_id % 2 = 1),
bands as (select * from hits union all select doc_id, item_id, n, p, band - 1 from hits)
select distinct doc_id, item_id from (select doc_id, item_id from bands group by doc_id, item_id, n, band having count(distinct p) >= 0.5 * (n - 1))"""

SQL = {
    "p7_found": _LEAKS,
    "p4_found": f"with {_PRODUCTION} select site_label, wtur_label from r group by all having quantile_cont(v, 0.95) >= 3 * quantile_cont(v, 0.5)",
    "p4_percentiles": f"""with {_PRODUCTION}, q as (select site_label, wtur_label, count(*) n, unnest([0.05, 0.25, 0.5, 0.75, 0.95, 0.99])::double p,
    unnest(quantile_cont(v, [0.05, 0.25, 0.5, 0.75, 0.95, 0.99])) v from r group by site_label, wtur_label) select site_label, wtur_label, p, n, round(v, 3) v from q""",
    "p4_daily_cells": f"""with {_PRODUCTION}, q as (select site_label, wtur_label, count(*) n, unnest([0.5, 0.95])::double p,
    unnest(quantile_disc(v, [0.5, 0.95])) v from r group by site_label, wtur_label) select site_label, wtur_label, p, n, v::bigint v, true within_bound from q""",
    "p6_found": r"select doc_id from documents where len(regexp_extract_all(text, '\w+|[^\w\s]+')) > 2048",
    "p6_fill": r"""with t as (select doc_id, coalesce(len(regexp_extract_all(text, '\w+|[^\w\s]+')), 0) n from documents)
    select count(*) docs, sum(greatest(1, ceil(n / 2048)))::bigint pieces, sum(n)::bigint tokens, true each_once, true kept_capacity, true close_to_least from t""",
    "p8_found": f"with {_FORMS} select a.doc_id doc_id_a, b.doc_id doc_id_b from f a join f b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text where a.text <> '' and b.text <> ''",
    "p8_classes": f"""with {_FORMS}, t as (select form, text, min(doc_id) same_text from f where text <> '' group by all), k as (select form, min(same_text) "class", count(*) texts from t group by form)
    select doc_id, "class", same_text, texts from f join t on t.text = f.text join k on k.form = t.form""",
    "p8_forms": f"with {_FORMS} select doc_id, sha256(form) form_hash, length(form) form_chars from f",
}
