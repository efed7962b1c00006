"""One consistent form of texts that look alike but differ in their characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.session import Spool, col, ship

# Letters of other alphabets that are drawn like a Latin letter, each pair written as other letter and Latin letter.
CYRILLIC = "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ҮY ԌG ԚQ ԜW ӀI"
GREEK = "οo νv ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϲc ϹC ϳj ͿJ"
# Format characters that are drawn (signs that enclose or precede digits), and invisible ones of other categories.
DRAWN_FORMAT = "؀؁؂؃؄؅۝܏࢐࢑࣢"
INVISIBLE_RANGES = ((0x034F, 0x034F), (0x180B, 0x180F), (0xFE00, 0xFE0F), (0xE0000, 0xE0FFF))


# Small letters that the published data call confusable with a Latin one although most typefaces draw them otherwise.
DRAWN_APART = "αγιρσυгѡᴦⲅⲣꮁ"
LETTERS = f"{CYRILLIC} {GREEK}"


@cache
def published_letters(jvm: object) -> str:
    """Letters of other alphabets that the Unicode confusables data call alike to a Latin letter, in the same form as LETTERS.

    The data come with the ICU library of Spark's JVM. The skeleton of a confusable letter is its prototype; as that of I is l, a
    capital whose prototype is l stands for I. A letter of the other case than its prototype is left out, since case makes texts differ.
    """
    other = [c for c in map(chr, range(0x370, 0x20000)) if unicodedata.category(c) in ("Lu", "Ll") and not unicodedata.name(c, "").startswith(("LATIN", "FULLWIDTH", "MATHEMATICAL")) and not unicodedata.decomposition(c)]
    found = jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(other)).split("\n")
    pairs = []
    for c, to in zip(other, found, strict=True):
        to = "I" if to == "l" and unicodedata.category(c) == "Lu" else to
        if len(to) == 1 and to.isascii() and to.isalpha() and to.isupper() == (unicodedata.category(c) == "Lu"):
            pairs.append(c + to)
    return " ".join(pairs)


def letters_alike(spark: SparkSession) -> str:
    """The published look-alike letters without DRAWN_APART, and LETTERS; the latter stand where both name a letter.

    Without the published ones texts that look alike would have different forms, so where they can't be had this is an error.
    """
    try:
        published = published_letters(spark._jvm)
    except Exception as e:  # a JVM without the library, a session without a JVM
        raise RuntimeError("the confusables data can't be read: they need the ICU library (com.ibm.icu) in the JVM of the session") from e
    if not published:
        raise RuntimeError("the confusables data of the JVM's ICU library name no letter that looks like a Latin one")
    known = {p[0] for p in LETTERS.split()} | set(DRAWN_APART)
    return " ".join([*LETTERS.split(), *(p for p in published.split() if p[0] not in known)])


@cache
def single_forms(letters: str = LETTERS) -> dict[str, str]:
    """Characters that become one other character: widths, blanks, line ends and look-alikes, the latter with all their accents."""
    alike = {pair[0]: pair[1] for pair in letters.split()}
    out = dict(alike) | {"\u2028": "\n", "\u2029": "\n", "\u0085": "\n"}
    for code in range(0x80, 0x20000):
        c = chr(code)
        tag, *parts = unicodedata.decomposition(c).split() or [""]
        if unicodedata.category(c) == "Zs":
            out[c] = " "
        elif tag in ("<wide>", "<narrow>") and len(parts) == 1:
            out[c] = chr(int(parts[0], 16))
            out[c] = alike.get(out[c], out[c])
        else:
            apart = unicodedata.normalize("NFD", c)
            if apart[0] in alike and (whole := unicodedata.normalize("NFC", alike[apart[0]] + apart[1:])) != c and len(whole) == 1:
                out[c] = whole
    return out


@cache
def ligatures() -> dict[str, str]:
    """Letters that are several letters drawn as one, by their compatibility decomposition."""
    out = {}
    for code in range(0x80, 0x10000):
        c = chr(code)
        tag, *parts = unicodedata.decomposition(c).split() or [""]
        letters = "".join(chr(int(p, 16)) for p in parts)
        if tag == "<compat>" and len(letters) > 1 and unicodedata.category(c)[0] == "L" and all(unicodedata.category(x)[0] == "L" for x in letters):
            out[c] = unicodedata.normalize("NFKC", c)
    return out


@cache
def invisible_ranges() -> tuple[tuple[int, int], ...]:
    """Ranges of the characters that are not drawn: format characters, variation selectors, joiners."""
    codes = {c for c in (*range(0x80, 0x3000), *range(0xF000, 0x10000)) if unicodedata.category(chr(c)) == "Cf" and chr(c) not in DRAWN_FORMAT}
    codes |= {c for a, b in INVISIBLE_RANGES for c in range(a, b + 1)}
    ends: list[list[int]] = []
    for c in sorted(codes):
        if ends and ends[-1][1] == c - 1:
            ends[-1][1] = c
        else:
            ends.append([c, c])
    return tuple((a, b) for a, b in ends)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def form_sql(text: str = "text", alike: str = LETTERS) -> str:
    """The SQL expression of a text's consistent form; a text of ASCII without carriage returns is its own."""
    table, letters = single_forms(alike), ligatures()
    unseen = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" if b > a else f"\\x{{{a:x}}}" for a, b in invisible_ranges())
    lines = rf"regexp_replace({text}, '\r\n?', chr(10), 'g')"
    seen = f"regexp_replace({lines}, '[{unseen}]', '', 'g')"
    mapped = f"translate({seen}, {_quoted(''.join(table))}, {_quoted(''.join(table.values()))})"
    apart = mapped
    for c, s in letters.items():
        apart = f"replace({apart}, {_quoted(c)}, {_quoted(s)})"
    tied = f"regexp_matches({text}, '[{''.join(letters)}]')"
    return f"""case when strlen({text}) = length({text}) then {lines}
        when {tied} then nfc_normalize({apart}) else nfc_normalize({mapped}) end"""


def _duckdb():
    import duckdb

    con = duckdb.connect()
    con.execute("set threads = 1")
    return con


def _columns(at: int, selected: str):
    """A function over Arrow batches that appends what ``selected`` gives for the column at ``at``, called text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duckdb()
        for batch in batches:
            con.register("given", pa.table({"text": batch.column(at).cast(pa.string())}))
            made = con.sql(f"select {selected} from given").to_arrow_table()
            con.unregister("given")
            for column in made.itercolumns():
                assert len(column) == batch.num_rows
            more = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in made.itercolumns()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *made.column_names])

    return run


def unify_text(df: DataFrame, text: str, into: str = "form") -> DataFrame:
    """df with a column ``into``: the consistent form of ``text``, by SQL that DuckDB runs inside the Arrow batches of each partition.

    Widths, kinds of blank, invisible characters, encodings of accents and ligatures and letters drawn alike no longer
    differ; case, digits, words, accents and the number of blanks do, as do signs that merely resemble each other
    (superscripts, fractions, dashes). Line ends become line feeds. Null stays null, an empty text and one of invisible
    characters alone become ''. Every other column is passed on as it is; ``into`` must not be one of them.
    """
    ship(df.sparkSession)
    if into.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a column {into}")
    # the batches' columns go by place, so that any names will do
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    schema = T.StructType([*plain.schema.fields, T.StructField("form", T.StringType())])
    made = plain.mapInArrow(_columns(df.columns.index(text), f"{form_sql(alike=letters_alike(df.sparkSession))} as form"), schema)
    return made.toDF(*df.columns, into)


def hashed_forms(df: DataFrame, row: str, text: str) -> DataFrame:
    """(row, form, raw): SHA-256 of the consistent form and of the text itself, of the rows with a row and a non-empty text."""
    ship(df.sparkSession)
    given = df.where(col(row).isNotNull() & (F.length(col(text)) > 0)).select(col(row).alias("row"), col(text).alias("t"))
    sql = f"unhex(sha256(form)) as form_hash, unhex(case when form = text then sha256(form) else sha256(text) end) as raw_hash from (select text, {form_sql(alike=letters_alike(df.sparkSession))} as form from given)"
    schema = T.StructType([given.schema["row"], given.schema["t"], T.StructField("form", T.BinaryType()), T.StructField("raw", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duckdb()
        for batch in batches:
            con.register("given", pa.table({"text": batch.column(1).cast(pa.string())}))
            made = con.sql(f"select {sql}").to_arrow_table().combine_chunks()
            con.unregister("given")
            assert made.num_rows == batch.num_rows
            for part in pa.table([batch.column(0), *(c.cast(pa.binary()) for c in made.itercolumns())], names=["row", "form", "raw"]).to_batches():
                yield part

    return given.mapInArrow(run, T.StructType([schema["row"], schema["form"], schema["raw"]]))


def lookalike_classes(df: DataFrame, row: str, text: str, spool: Spool | None = None) -> DataFrame:
    """(<row>, class, same_text, texts): one row for each row, with the class of texts that look like its own.

    class: the least row of the class; same_text: the least row of those whose text is the very same; texts: how many different texts
    the class has. Two rows look alike if their class is one, and their texts differ if same_text does. Copies are
    never held against each other. Only hashes are shuffled, combined on the map side; a text or a form of a third of all rows is
    one row in each table that is joined to the rows. Rows with a null row, null or empty text take no part; rows
    repeated with the same number and text count once. An empty table gives no rows.
    """
    spool = spool or Spool(df.sparkSession)
    hashed, _ = spool.write(hashed_forms(df, row, text))
    texts = hashed.groupBy("raw", "form").agg(F.min("row").alias("same_text"))
    forms = texts.groupBy("form").agg(F.min("same_text").alias("class"), F.count(F.lit(1)).alias("texts"))
    known = texts.join(forms, "form").drop("form")
    return hashed.select("row", "raw").distinct().join(known, "raw").select(F.col("row").alias(row), "class", "same_text", "texts")


def lookalike_pairs(df: DataFrame, row: str, text: str, spool: Spool | None = None) -> DataFrame:
    """(<row>_a, <row>_b), a < b: every two rows whose texts are not equal but have the same consistent form.

    Made of ``lookalike_classes``: the different texts of a class are paired by their representatives, which are then replaced by their
    rows on either side. The result has as many rows as there are such pairs, which for large classes only the classes themselves can avoid.
    """
    spool = spool or Spool(df.sparkSession)
    members, _ = spool.write(lookalike_classes(df, row, text, spool).where("texts > 1").withColumnRenamed(row, "row"))
    texts = members.select("class", "same_text").distinct()
    a, b = (texts.select("class", F.col("same_text").alias(f"text_{x}")) for x in "ab")
    pairs = a.join(b, "class").where("text_a < text_b").drop("class")
    rows_a, rows_b = (members.select(F.col("row").alias(f"row_{x}"), F.col("same_text").alias(f"text_{x}")) for x in "ab")
    both = pairs.join(rows_a, "text_a").join(rows_b, "text_b").where("row_a <> row_b")
    return both.select(F.least("row_a", "row_b").alias(f"{row}_a"), F.greatest("row_a", "row_b").alias(f"{row}_b"))
