"""Templates expanded over DataFrames into triples."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from pathlib import Path
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.operators.ordered import positions
from tidegraph.session import Spool, col
from tidegraph.sparql.algebra import Triple
from tidegraph.stottr.parser import ANY_URI, NONE, OTTR, TRIPLE, Argument, Instance, ListTerm, Parameter, Template, Templates, Type, parse_document
from tidegraph.terms import RDF, XSD, Blank, Iri, Literal, Var

KEY = "Key"
#: The datatype that a column's values have.
XSD_OF = {T.StringType: "string", T.BooleanType: "boolean", T.LongType: "long", T.IntegerType: "int", T.ShortType: "short", T.ByteType: "byte", T.DoubleType: "double", T.FloatType: "float", T.TimestampType: "dateTime", T.TimestampNTZType: "dateTime"}
#: Datatypes that a column of another type may be declared to have, where all its values are in range.
ALSO = {"long": {"integer", "unsignedInt", "unsignedLong"}, "int": {"integer"}, "double": {"decimal"}, "string": set()}


class MappingError(ValueError):
    """A DataFrame does not fit the template it is to fill."""


class KeyColumnError(MappingError):
    """The Key column is missing, not of strings, null or not unique."""


class MissingKeyColumn(KeyColumnError):
    pass


class InvalidKeyColumnType(KeyColumnError):
    pass


class DuplicateKeys(KeyColumnError):
    pass


class MissingColumn(MappingError):
    pass


class MissingForeignKeyColumn(MissingColumn):
    pass


class UnknownTimeZone(MappingError):
    pass


class UnlikeTerms(MappingError):
    """The terms of a constant list are of several types."""


class IrrelevantColumn(MappingError):
    pass


class ColumnTypeMismatch(MappingError):
    pass


class PTypeNotSupported(MappingError):
    pass


class TypeNotInferred(PTypeNotSupported):
    """A column's type has no datatype."""


class NonOptionalNull(MappingError):
    pass


class NonBlankViolated(MappingError):
    pass


class MintingError(MappingError):
    pass


class MintedBefore(MintingError):
    """A key has an IRI for this argument already."""


class ResolvingError(MappingError):
    pass


class NothingMintedForTemplate(ResolvingError):
    pass


class NothingMintedForArgument(ResolvingError):
    pass


@dataclass(frozen=True)
class MintingOptions:
    """IRIs prefix + n, n counting from start in order of Key (rows of a DataFrame have no order of their own); a list of them per row if a length or a column of the same length is given."""

    prefix: str
    start: int = 0
    list_length: int | None = None
    same_length_as: str | None = None


@dataclass(frozen=True)
class ResolveIRI:
    """IRIs that were minted for an argument of a template, looked up by the keys in a column."""

    key_column: str
    template: str
    argument: str


@dataclass
class Value:
    """What a variable stands for: a column of names, of literals with their datatype and tag, or of lists of such."""

    kind: str  # iri, literal, none, list
    column: Column
    datatype: str | None = None
    lang: str | None = None
    of: Value | None = None
    zone: str | None = None


def _check_zone(zone: str) -> None:
    try:
        ZoneInfo(zone)
    except (ZoneInfoNotFoundError, ValueError) as e:
        raise UnknownTimeZone(f"{zone} is no time zone") from e


def lexical(v: Value) -> Column:
    """The lexical form of a literal."""
    local = (v.datatype or "").removeprefix(XSD)
    if local in ("dateTime", "dateTimeStamp"):
        at = v.column.cast("timestamp")
        if local == "dateTime":
            return _trimmed(at)
        there = F.from_utc_timestamp(at, v.zone or "UTC")
        minutes = ((F.unix_micros(there) - F.unix_micros(at)) / 60_000_000).cast("int")
        size = F.abs(minutes)
        return F.concat(_trimmed(there), F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0"))
    return v.column.cast("string")


def _trimmed(at: Column) -> Column:
    """A time whose fraction stands only if it is not zero."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(at, "SSSSSS")
    return F.when(part == "000000", whole).otherwise(F.concat(whole, F.lit("."), F.when(F.endswith(part, F.lit("000")), F.substring(part, 1, 3)).otherwise(part)))


class Mapping:
    """Expands templates and gathers the triples; everything stays lazy but the checks of the input, minting and resolving."""

    def __init__(self, documents: str | Iterable[str] = (), spark: SparkSession | None = None) -> None:
        parsed = [parse_document(d) for d in ([documents] if isinstance(documents, str) else documents)]
        self.templates = Templates(parsed)
        self.spark = spark or SparkSession.getActiveSession()
        self.minted: dict[str, DataFrame] = {}
        self.frames: list[DataFrame] = []
        self.spool: Spool | None = None
        for d in parsed:
            for i in d.instances:
                self.templates._check(i, "the document")
                self.frames += self._instance(i, self.spark.range(1).select(F.lit("").alias(KEY)), {})

    @classmethod
    def from_files(cls, *paths: str, spark: SparkSession | None = None) -> Mapping:
        """Of .stottr files and folders of such."""
        files = [f for p in map(Path, paths) for f in (sorted(p.glob("*.stottr")) if p.is_dir() else [p])]
        return cls([f.read_text() for f in files], spark)

    # expansion ----------------------------------------------------------------------------------

    def expand(
        self, template: str, df: DataFrame, resolve_iris: dict[str, ResolveIRI] | None = None, mint_iris: dict[str, MintingOptions] | None = None,
        language_tags: dict[str, str] | None = None, time_zones: dict[str, str] | None = None, validate: bool = True,
    ) -> Mapping:
        """Fills a template with each row of df, which has a column for each parameter and a unique string column Key.

        A parameter may be minted or resolved in place of a column, or be left out if it has a default. Null in a parameter
        that is not optional is an error, as is a blank node in a non-blank one; rows whose subject, predicate or object is null
        give no triple. time_zones makes a timestamp column a dateTimeStamp of that zone. validate=False spares the checks that read the rows.
        """
        t = self.templates.find(template)
        resolve_iris, mint_iris, language_tags, time_zones = resolve_iris or {}, mint_iris or {}, language_tags or {}, time_zones or {}
        self._check_columns(t, df, resolve_iris, mint_iris, validate)
        for zone in time_zones.values():
            _check_zone(zone)
        for name, r in resolve_iris.items():
            df = self._resolve(df, name, r)
        if mint_iris:
            df = self._mint(t, df, mint_iris, validate)
        made = set(mint_iris) | set(resolve_iris)
        env: dict[str, Value] = {}
        for p in t.parameters:
            if p.name in df.columns:
                v = self._column(p, df, language_tags.get(p.name), time_zones.get(p.name), p.name in made)
                if p.default is not None and p.default is not NONE and v.kind != "list":
                    d = self._constant(p.default)
                    v = Value(v.kind, F.coalesce(lexical(v) if v.kind == "literal" else v.column, lexical(d) if d.kind == "literal" else d.column), v.datatype, v.lang)
                env[p.name] = v
            else:
                env[p.name] = self._constant(p.default)
        if validate:
            self._check_rows(t, df)
        self.frames += self._template(t, df, env)
        return self

    def _check_columns(self, t: Template, df: DataFrame, resolve: dict, mint: dict, validate: bool) -> None:
        if KEY not in df.columns:
            raise MissingKeyColumn(f"a column {KEY} is needed")
        if not isinstance(df.schema[KEY].dataType, T.StringType):
            raise InvalidKeyColumnType(f"the column {KEY} is of type {df.schema[KEY].dataType.simpleString()}, not string")
        names = {p.name for p in t.parameters}
        for given in (*resolve, *mint):
            if given not in names:
                raise MappingError(f"{given} is no parameter of {t.iri}")
            if given in df.columns:
                raise MappingError(f"{given} is both a column and to be minted or resolved")
        keys = {r.key_column for r in resolve.values()}
        missing = [p.name for p in t.parameters if p.name not in df.columns and p.name not in mint and p.name not in resolve and p.default is None and not p.optional]
        absent = [k for k in keys if k not in df.columns]
        if absent:
            raise MissingForeignKeyColumn(f"columns {absent} of keys to be resolved are missing")
        if missing:
            raise MissingColumn(f"columns {missing} are missing")
        extra = [c for c in df.columns if c not in names and c != KEY and c not in keys]
        if extra:
            raise IrrelevantColumn(f"columns {extra} are of no use to {t.iri}")
        if validate:
            bad = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col(KEY).isNull() | (F.col("n") > 1)).limit(5).collect()
            if bad:
                raise DuplicateKeys(f"keys null or not unique: {[r[KEY] for r in bad]}")

    def _check_rows(self, t: Template, df: DataFrame) -> None:
        for p in t.parameters:
            if p.name not in df.columns:
                continue
            if not p.optional and p.default is None:
                bad = df.where(col(p.name).isNull()).select(KEY).limit(10).collect()
                if bad:
                    raise NonOptionalNull(f"{p.name} is null for keys {[r[KEY] for r in bad]}")
            if p.non_blank and isinstance(df.schema[p.name].dataType, T.StringType):
                bad = df.where(F.startswith(col(p.name), F.lit("_:"))).select(KEY).limit(10).collect()
                if bad:
                    raise NonBlankViolated(f"{p.name} is a blank node for keys {[r[KEY] for r in bad]}")

    def _column(self, p: Parameter, df: DataFrame, lang: str | None, zone: str | None, made: bool) -> Value:
        return self._typed(col(p.name), df.schema[p.name].dataType, ANY_URI if made and p.type is None else p.type, lang, zone, p.name)

    def _typed(self, c: Column, kind: T.DataType, wanted: Type | None, lang: str | None, zone: str | None, name: str) -> Value:
        while wanted is not None and wanted.name == "LUB":
            wanted = wanted.of
        if isinstance(kind, T.ArrayType):
            if wanted is not None and wanted.name not in ("List", "NEList") and wanted.name != ANY_URI.name:
                raise ColumnTypeMismatch(f"{name} holds lists, but {wanted} is wanted")
            of = wanted.of if wanted is not None and wanted.of else wanted if wanted == ANY_URI else None
            return Value("list", c, of=self._typed(c, kind.elementType, of, lang, zone, name))
        if wanted is not None and wanted.name in ("List", "NEList"):
            raise ColumnTypeMismatch(f"{name} is to hold lists")
        if wanted is not None and wanted.name in (XSD + "anyURI", OTTR + "IRI", "http://www.w3.org/2000/01/rdf-schema#Resource") and (isinstance(kind, T.StringType) or wanted.name == XSD + "anyURI"):
            if not isinstance(kind, (T.StringType, T.NullType)):
                raise ColumnTypeMismatch(f"{name} is to hold IRIs, not {kind.simpleString()}")
            return Value("iri", c)
        if isinstance(kind, (T.DateType, T.DayTimeIntervalType)):
            raise PTypeNotSupported(f"{name} is of type {kind.simpleString()}, which is not supported")
        local = "unsignedLong" if isinstance(kind, T.DecimalType) and (kind.precision, kind.scale) == (20, 0) else "decimal" if isinstance(kind, T.DecimalType) else XSD_OF.get(type(kind))
        if isinstance(kind, T.NullType):
            return Value("none", F.lit(None).cast("string"))
        if local is None:
            raise TypeNotInferred(f"{name} is of type {kind.simpleString()}, which is not supported")
        if zone:
            local = "dateTimeStamp"
        if wanted is not None and wanted.name.startswith(XSD) and wanted.name != XSD + local:
            if wanted.name.removeprefix(XSD) not in ALSO.get(local, ()):
                raise ColumnTypeMismatch(f"{name} is to hold {wanted}, but is of {local}")
            local = wanted.name.removeprefix(XSD)
        if lang:
            if local != "string":
                raise ColumnTypeMismatch(f"{name} has a language tag but is no text")
            return Value("literal", c, RDF + "langString", lang)
        return Value("literal", c, XSD + local, zone=zone)

    def _constant(self, term: object) -> Value:
        if term is None or term is NONE:
            return Value("none", F.lit(None).cast("string"))
        if isinstance(term, Iri):
            return Value("iri", F.lit(term.value))
        if isinstance(term, Blank):
            return Value("iri", F.lit(f"_:{term.label}"))
        if isinstance(term, Literal):
            # the lexical form stays as it is written
            return Value("literal", F.lit(term.lexical), term.datatype if term.datatype not in (XSD + "dateTime", XSD + "dateTimeStamp") else term.datatype + "#", term.lang)
        raise MappingError(f"{term} is no constant")

    def _term(self, term: object, env: dict[str, Value]) -> Value:
        if isinstance(term, Var):
            return env[term.name]
        if isinstance(term, ListTerm):
            items = [self._term(x, env) for x in term.items]
            kinds = {(v.kind, v.datatype, v.lang) for v in items}
            if len(kinds) > 1:
                raise UnlikeTerms(f"a list holds terms of {len(kinds)} types")
            if not items:
                return Value("list", F.array().cast("array<string>"), of=Value("none", F.lit(None).cast("string")))
            one = items[0]
            columns = [lexical(v) if v.kind == "literal" else v.column for v in items]
            return Value("list", F.array(*columns), of=Value(one.kind, columns[0], (one.datatype or "") + "#" if one.datatype else None, one.lang, one.of))
        return self._constant(term)

    def _template(self, t: Template, df: DataFrame, env: dict[str, Value]) -> list[DataFrame]:
        if t.iri == TRIPLE:
            return [self._triple(df, *(env[n] for n in ("subject", "verb", "object")))]
        if t.signature_only:
            raise MappingError(f"{t.iri} has a signature only")
        return [f for i in t.patterns for f in self._instance(i, df, env)]

    def _instance(self, i: Instance, df: DataFrame, env: dict[str, Value]) -> list[DataFrame]:
        t = self.templates.by_iri[i.template]
        values: list[Value] = []
        spread: list[int] = []
        for a in (*i.arguments, *(Argument(p.default) for p in t.parameters[len(i.arguments) :])):
            v = self._term(a.term, env)
            if a.expand:
                if v.kind not in ("list", "none"):
                    raise MappingError(f"++ needs a list for {i.template}")
                if v.kind == "list":
                    spread.append(len(values))
            values.append(v)
        if spread:
            # other arguments are kept as columns of their own, since exploding makes new rows of all
            lists = [f"__l{len(df.columns)}_{k}" for k in spread]
            df = df.withColumns({n: values[k].column for n, k in zip(lists, spread)})
            if i.expander == "cross":
                for n in lists:
                    df = df.withColumn(n, F.explode(col(n)))
            else:
                sizes = [F.size(col(n)) for n in lists]
                length = (F.least if i.expander == "zipMin" else F.greatest)(*sizes) if len(sizes) > 1 else sizes[0]
                at = lists[0] + "_at"
                df = df.where(F.coalesce(length, F.lit(0)) > 0).withColumn(at, F.explode(F.sequence(F.lit(0), length - 1)))
                df = df.withColumns({n: F.get(col(n), col(at)) for n in lists})
            for n, k in zip(lists, spread):
                of = values[k].of
                values[k] = Value(of.kind, col(n), of.datatype, of.lang, of.of, of.zone)
        called = {}
        for p, v in zip(t.parameters, values):
            if v.kind == "none" and p.default is not None and p.default is not NONE:
                v = self._constant(p.default)
            called[p.name] = v
        return self._template(t, df, called)

    def _triple(self, df: DataFrame, s: Value, p: Value, o: Value) -> DataFrame:
        for v, what in ((s, "subject"), (p, "predicate")):
            if v.kind not in ("iri", "none"):
                raise ColumnTypeMismatch(f"a {what} must be an IRI")
        if o.kind == "list":
            raise ColumnTypeMismatch("an object must not be a list; expand it")
        literal = o.kind == "literal"
        value = lexical(o) if literal else o.column
        kind = F.lit("literal") if literal else F.when(F.startswith(value, F.lit("_:")), "blank").otherwise("iri")
        out = df.select(s.column.cast("string").alias("s"), p.column.cast("string").alias("p"), value.cast("string").alias("o"), kind.alias("o_kind"), F.lit(o.datatype.rstrip("#") if literal else None).cast("string").alias("o_dt"), F.lit(o.lang).cast("string").alias("o_lang"))
        return out.where("s is not null and p is not null and o is not null")

    # minting and resolving ----------------------------------------------------------------------

    def _mint(self, t: Template, df: DataFrame, mint: dict[str, MintingOptions], validate: bool = True) -> DataFrame:
        """Adds minted IRIs. Keys are numbered over range partitions; of lists, the first number of a row is the sum of the lengths before it."""
        self.spool = self.spool or Spool(df.sparkSession)
        sizes = {}
        for name, m in mint.items():
            if m.list_length is not None and m.same_length_as is not None:
                raise MintingError("a list has either a length or that of a column")
            if m.same_length_as is not None and m.same_length_as not in df.columns:
                raise MintingError(f"{m.same_length_as} is no column")
            sizes[name] = F.lit(m.list_length) if m.list_length is not None else F.coalesce(F.size(col(m.same_length_as)), F.lit(0)) if m.same_length_as else None
        plain = df.toDF(*(f"c{i}" for i in range(len(df.columns)))).withColumn("one", F.lit(1))
        key = f"c{df.columns.index(KEY)}"
        placed, _ = positions(plain, "one", (key,), self.spool)
        placed = placed.drop("one").toDF(*df.columns, "__pos")
        for name, m in mint.items():
            numbered = lambda n: F.concat(F.lit(m.prefix), n.cast("string"))  # noqa: B023, E731
            if sizes[name] is None:
                placed = placed.withColumn(name, numbered(F.lit(m.start) + F.col("__pos")))
            elif m.list_length is not None:
                first = F.lit(m.start) + F.col("__pos") * m.list_length
                placed = placed.withColumn(name, F.transform(F.sequence(first, first + m.list_length - 1), numbered))
            else:
                # a row's first number is the sum of the lengths before it, by the same order of keys
                n = F.greatest(F.size(col(m.same_length_as)), F.lit(0)).cast("bigint")
                names = placed.columns
                given = placed.toDF(*(f"c{i}" for i in range(len(names)))).withColumns({"one": F.lit(1), "n": F.greatest(F.coalesce(F.size(f"c{names.index(m.same_length_as)}"), F.lit(0)), F.lit(0)).cast("bigint")})
                summed, _ = positions(given, "one", (f"c{names.index('__pos')}",), self.spool, "n")
                placed = summed.drop("one", "n").toDF(*names, "__before")
                first = F.col("__before") + m.start
                empty = F.array().cast("array<string>")
                placed = placed.withColumn(name, F.when(n > 0, F.transform(F.sequence(first, first + n - 1), numbered)).otherwise(empty)).drop("__before")
        placed = placed.drop("__pos")
        own = placed.select(KEY, *mint)
        if t.iri in self.minted and validate:
            again = set(mint) & set(self.minted[t.iri].columns)
            known = self.minted[t.iri].where(reduce(lambda x, y: x | y, (col(n).isNotNull() for n in again))).select(KEY) if again else None
            bad = own.join(known, KEY, "left_semi").limit(5).collect() if again else []
            if bad:
                raise MintedBefore(f"keys with IRIs for {sorted(again)} already: {[r[KEY] for r in bad]}")
        self.minted[t.iri] = own if t.iri not in self.minted else self.minted[t.iri].unionByName(own, allowMissingColumns=True)
        return placed

    def _resolve(self, df: DataFrame, name: str, r: ResolveIRI) -> DataFrame:
        """Left join on the keys; a key without an IRI gives null, in lists of any depth too; a list without elements gives null."""
        iri = self.templates.find(r.template).iri
        if iri not in self.minted:
            raise NothingMintedForTemplate(f"no IRIs were minted for {r.template} before")
        if r.argument not in self.minted[iri].columns:
            raise NothingMintedForArgument(f"{r.argument} of {r.template} was not minted before")
        known = self.minted[iri].select(F.col(KEY).alias("__k"), col(r.argument).alias(name))
        kind, depth = df.schema[r.key_column].dataType, 0
        while isinstance(kind, T.ArrayType):
            kind, depth = kind.elementType, depth + 1
        if depth:
            lists = self._looked_up(df.select(KEY, col(r.key_column).alias("__v")), [KEY], depth, known.withColumnRenamed(name, "__iri"))
            return df.join(lists.select(F.col(KEY).alias("__key"), F.col("__v").alias(name)), F.col(KEY) == F.col("__key"), "left").drop("__key", r.key_column)
        return df.join(known, col(r.key_column) == F.col("__k"), "left").drop("__k", r.key_column)

    def _looked_up(self, rows: DataFrame, by: list[str], depth: int, known: DataFrame) -> DataFrame:
        """(by..., __v): in the lists __v of keys, nested ``depth`` deep, each key replaced by its IRI in its place."""
        at = f"__at{depth}"
        apart = rows.select(*by, F.posexplode("__v").alias(at, "__v"))
        if depth == 1:
            made = apart.join(known, F.col("__v") == F.col("__k"), "left").select(*by, at, F.col("__iri").alias("__v"))
        else:
            # lists without elements have no rows below, but keep their place
            made = apart.join(self._looked_up(apart, [*by, at], depth - 1, known).withColumnRenamed("__v", "__w"), [*by, at], "left").select(*by, at, F.coalesce("__w", F.when(F.size("__v") == 0, F.array())).alias("__v"))
        return made.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(at, "__v"))).alias("__l")).select(*by, F.transform("__l", lambda x: x["__v"]).alias("__v"))

    # results ------------------------------------------------------------------------------------

    def triples(self) -> DataFrame:
        """All triples so far (s, p, o, o_kind, o_dt, o_lang)."""
        if not self.frames:
            return self.spark.createDataFrame([], "s string, p string, o string, o_kind string, o_dt string, o_lang string")
        return reduce(DataFrame.unionByName, self.frames)

    def write_ntriples(self, path: str) -> None:
        write_ntriples(self.triples(), path)

    def objects(self) -> Iterator[Triple]:
        """The triples as objects, of Iri, Blank and Literal; the driver holds one partition of them at a time."""
        node = lambda x: Blank(x.removeprefix("_:")) if x.startswith("_:") else Iri(x)
        for r in self.triples().toLocalIterator():
            o = Literal(r["o"], r["o_dt"] or XSD + "string", r["o_lang"]) if r["o_kind"] == "literal" else node(r["o"])
            yield Triple(node(r["s"]), Iri(r["p"]), o)

    def to_graph(self) -> object:
        """An rdflib Graph of the triples, where that library is installed."""
        import rdflib

        graph = rdflib.Graph()
        node = lambda x: rdflib.BNode(x.label) if isinstance(x, Blank) else rdflib.URIRef(x.value)
        for t in self.objects():
            o = rdflib.Literal(t.o.lexical, lang=t.o.lang) if isinstance(t.o, Literal) and t.o.lang else rdflib.Literal(t.o.lexical, datatype=t.o.datatype) if isinstance(t.o, Literal) else node(t.o)
            graph.add((node(t.s), node(t.p), o))
        return graph


def ntriples(triples: DataFrame) -> DataFrame:
    """(value): each triple as a line of N-Triples, escaped."""

    def text(c: str) -> Column:
        out = F.col(c)
        for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    node = lambda c: F.when(F.startswith(F.col(c), F.lit("_:")), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    tail = F.when(F.coalesce("o_lang", F.lit("")) != "", F.concat(F.lit('"@'), F.col("o_lang"))).when(F.col("o_dt").isNull() | (F.col("o_dt") == XSD + "string"), '"').otherwise(F.concat(F.lit('"^^<'), F.col("o_dt"), F.lit(">")))
    o = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), text("o"), tail)).otherwise(node("o"))
    return triples.select(F.concat_ws(" ", node("s"), node("p"), o, F.lit(".")).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    """Writes a folder of N-Triples files, one per partition."""
    ntriples(triples).write.mode("errorifexists").text(path)
