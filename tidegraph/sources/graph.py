"""The static graph: triples as a DataFrame, pattern scans and property paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.session import Spool
from tidegraph.sparql import algebra as A
from tidegraph.terms import Blank, Iri, Literal, Var, spark_type

#: Up to this number of predicates the triples are written by predicate.
MOST_PREDICATES = 1_000
TRIPLE_COLUMNS = ("s", "p", "o", "o_kind", "o_dt", "o_lang")


class TripleStore:
    """Triples (s, p, o, o_kind, o_dt, o_lang, all strings; optionally g) to be queried.

    prefixes: if the table holds names such as ``rdf:type`` in place of IRIs, what their prefixes stand for. Rows
    with a null s, p or o are no triples. A literal has o_kind 'literal', all others are names.

    distinct: a graph is a set, so repeated triples count once. They are removed once, before the first query, by writing the
    triples to the shared folder by predicate, where a pattern then reads its predicate alone (if there
    are over MOST_PREDICATES, in files sorted by predicate, of which it skips what its statistics rule out). They are written by ranges of (p, s, o), so a predicate with most of the triples is many tasks and a rare one is one file. False takes the table as it is, where it is known to have no repeats.
    """

    def __init__(self, triples: DataFrame, prefixes: dict[str, str] | None = None, distinct: bool = True) -> None:
        self.prefixes = sorted((prefixes or {}).items(), key=lambda x: -len(x[1]))
        self.graphs = "g" in triples.columns
        rows = triples.select(*TRIPLE_COLUMNS, *(["g"] if self.graphs else [])).where("s is not null and p is not null and o is not null")
        self.spark = triples.sparkSession
        self._rows_given, self._distinct = rows, distinct
        self._written: DataFrame | None = None
        self._kinds: dict[str, list[tuple[str, str | None]]] = {}

    @property
    def triples(self) -> DataFrame:
        if not self._distinct:
            return self._rows_given
        if self._written is None:
            spool = Spool(self.spark)
            few = self._rows_given.select("p").distinct().limit(MOST_PREDICATES + 1).count() <= MOST_PREDICATES
            rows = self._rows_given.distinct().repartitionByRange("p", "s", "o").sortWithinPartitions("p", "s")
            self._written = spool.write(rows, by=["p"] if few else None)[0]
        return self._written

    def save(self, path: str) -> None:
        """Writes the triples as they are kept for queries, to be loaded by later applications."""
        spread = self.triples.repartitionByRange("p", "s", "o").sortWithinPartitions("p", "s")
        spread.write.parquet(path, partitionBy=["p"] if self.triples.select("p").distinct().limit(MOST_PREDICATES + 1).count() <= MOST_PREDICATES else None)

    @classmethod
    def load(cls, spark: SparkSession, path: str, prefixes: dict[str, str] | None = None, graphs: bool = False) -> TripleStore:
        """What ``save`` wrote; nothing is written again. graphs: whether the triples are of named graphs."""
        columns = [*TRIPLE_COLUMNS, *(["g"] if graphs else [])]
        return cls(spark.read.schema(", ".join(f"{c} string" for c in columns)).parquet(path), prefixes, distinct=False)

    def name(self, iri: str) -> str:
        """An IRI as the table writes it."""
        for prefix, start in self.prefixes:
            if iri.startswith(start):
                return f"{prefix}:{iri[len(start):]}"
        return iri

    def learn(self, predicates: set[str]) -> None:
        """Looks up the kinds of object that these predicates have, a row for each datatype, in one job for all that are new."""
        new = {self.name(p) for p in predicates} - self._kinds.keys()
        if new:
            self._kinds |= {p: [] for p in new}
            for r in self.triples.where(F.col("p").isin(sorted(new))).groupBy("p").agg(F.collect_set(F.struct("o_kind", F.coalesce("o_dt", F.lit("")))).alias("kinds")).collect():
                self._kinds[r["p"]] = [(k[0], k[1] or None) for k in r["kinds"]]

    def object_type(self, predicate: object) -> T.DataType:
        """The Spark type of a predicate's objects: that of their one datatype, else string."""
        kinds = self._kinds.get(self.name(predicate.value), []) if isinstance(predicate, Iri) else []
        types = {spark_type(dt) if kind == "literal" else T.StringType() for kind, dt in kinds}
        return next(iter(types)) if len(types) == 1 and None not in types else T.StringType()

    def _is(self, column: str, term: object) -> Column:
        if isinstance(term, Literal):
            cond = (F.col("o") == term.lexical) & (F.col("o_kind") == "literal")
            if term.lang:
                return cond & (F.lower("o_lang") == term.lang.lower())
            full, short = term.datatype, self.name(term.datatype)
            plain = F.col("o_dt").isin(full, short, "xsd:" + full.rpartition("#")[2])
            return cond & F.col("o_lang").isNull() & (plain | F.col("o_dt").isNull() if full.endswith("#string") else plain)
        value = term.value if isinstance(term, Iri) else f"_:{term.label}" if isinstance(term, Blank) else str(term)
        cond = F.col(column) == self.name(value)
        return cond & (F.col("o_kind") != "literal") if column == "o" else cond

    def _rows(self, graph: object) -> DataFrame:
        if not self.graphs:
            return self.triples
        if graph is None:  # all graphs together, a triple of several counting once
            return self.triples.drop("g").distinct()
        return self.triples if isinstance(graph, Var) else self.triples.where(F.col("g") == self.name(graph.value)).drop("g")

    def scan(self, t: A.Triple, graph: object = None, typed: bool = True, meta: set[str] = frozenset()) -> tuple[DataFrame, dict[str, T.DataType]]:
        """Solutions of one triple pattern, and their types: a column for each variable; for those in ``meta`` also language, datatype and kind."""
        if not isinstance(t.p, (Iri, Var)):
            rows = self._ends(t, graph)
        else:
            rows = self._rows(graph)
        cond, columns = F.lit(True), {}
        for at, term in (("s", t.s), ("p", t.p), ("o", t.o)):
            if at == "p" and not isinstance(t.p, (Iri, Var)):
                continue
            if not isinstance(term, Var):
                cond &= self._is(at, term)
            elif term.name in columns:
                cond &= F.col(at) == F.col(columns[term.name])
            else:
                columns[term.name] = at
        kind = self.object_type(t.p) if typed else T.StringType()
        out, types = [], {}
        for name, at in columns.items():
            c = F.col(at)
            types[name] = kind if at == "o" else T.StringType()
            out.append((c.try_cast(kind) if at == "o" and not isinstance(kind, T.StringType) else c).alias(name))
            if name in meta and isinstance(t.p, (Iri, Var)):
                literal = (F.col("o_kind") == "literal") if at == "o" else F.lit(False)
                out += [F.when(literal, F.coalesce("o_lang", F.lit(""))).alias(f"{name}@lang"), F.when(literal, F.coalesce("o_dt", F.lit("xsd:string"))).alias(f"{name}@dt"), literal.alias(f"{name}@literal")]
                types |= {f"{name}@lang": T.StringType(), f"{name}@dt": T.StringType(), f"{name}@literal": T.BooleanType()}
        if isinstance(graph, Var) and self.graphs:
            out.append(F.col("g").alias(graph.name))
            types[graph.name] = T.StringType()
        return rows.where(cond).select(*out), types

    # paths --------------------------------------------------------------------------------------

    def _ends(self, t: A.Triple, graph: object) -> DataFrame:
        """(s, o, o_kind, o_dt, o_lang) of a property path."""
        rows = self._rows(graph)
        if isinstance(t.p, A.Repeat) and t.p.sign != "?" and isinstance(t.o, Iri) and not isinstance(t.s, Iri):
            turned = self._closure(A.Inverse(t.p.path), rows, t.p.sign == "*", self.name(t.o.value))
            pairs = turned.select(F.col("o").alias("s"), F.col("s").alias("o"))
        elif isinstance(t.p, A.Repeat) and t.p.sign != "?":
            pairs = self._closure(t.p.path, rows, t.p.sign == "*", self.name(t.s.value) if isinstance(t.s, Iri) else None)
        else:
            pairs = self.path(t.p, rows)
        literal = F.lit("literal" if isinstance(t.o, Literal) else "iri")
        return pairs.select("s", "o", literal.alias("o_kind"), F.lit(t.o.datatype if isinstance(t.o, Literal) else None).cast("string").alias("o_dt"), F.lit(t.o.lang if isinstance(t.o, Literal) else None).cast("string").alias("o_lang"))

    def path(self, p: object, rows: DataFrame) -> DataFrame:
        """(s, o) of every two nodes that a path connects."""
        if isinstance(p, Iri):
            return rows.where(F.col("p") == self.name(p.value)).select("s", "o")
        if isinstance(p, A.Inverse):
            return self.path(p.path, rows).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if isinstance(p, A.Sequence):
            step = lambda a, b: a.withColumnRenamed("o", "m").join(b.withColumnRenamed("s", "m"), "m").select("s", "o")
            return reduce(step, (self.path(x, rows) for x in p.parts))
        if isinstance(p, A.Alternative):
            return reduce(DataFrame.unionByName, (self.path(x, rows) for x in p.parts))
        if isinstance(p, A.Negated):
            names = lambda ps: [self.name(x.value) for x in ps]
            out = []
            if p.forward or not p.backward:
                out.append(rows.where(~F.col("p").isin(names(p.forward))).select("s", "o"))
            if p.backward:
                out.append(rows.where(~F.col("p").isin(names(p.backward))).select(F.col("o").alias("s"), F.col("s").alias("o")))
            return reduce(DataFrame.unionByName, out)
        if p.sign == "?":
            return self.path(p.path, rows).unionByName(self._identity(rows, None)).distinct()
        return self._closure(p.path, rows, p.sign == "*", None)

    def _identity(self, rows: DataFrame, start: str | None) -> DataFrame:
        if start is not None:
            return self.spark.createDataFrame([(start, start)], "s string, o string")
        nodes = rows.select(F.col("s").alias("n")).unionByName(rows.select(F.col("o").alias("n"))).distinct()
        return nodes.select(F.col("n").alias("s"), F.col("n").alias("o"))

    def _closure(self, p: object, rows: DataFrame, reflexive: bool, start: str | None) -> DataFrame:
        """Pairs connected by one step or more (none or more), of one start if given.

        Each round joins the steps to the pairs found in the last one and keeps those that are new; rounds are written to the shared folder.
        """
        spool = Spool(self.spark)
        steps, _ = spool.write(self.path(p, rows).distinct())
        front = steps if start is None else steps.where(F.col("s") == start)
        seen, seen_at = spool.write(front)
        front = seen
        while True:
            ahead = front.withColumnRenamed("o", "m").join(steps.withColumnRenamed("s", "m"), "m").select("s", "o").distinct()
            front, front_at = spool.write(ahead.join(seen, ["s", "o"], "left_anti"))
            if front.isEmpty():
                break
            new, new_at = spool.write(seen.unionByName(front))
            spool.drop(seen_at)
            seen, seen_at = new, new_at
        return seen.unionByName(self._identity(rows, start)).distinct() if reflexive else seen
