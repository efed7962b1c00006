"""Algebra to one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime, timedelta
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.functions.aggregates import aggregate
from tidegraph.functions.expressions import NUMERIC, WHOLE, Expressions, Typed
from tidegraph.session import Spool, col
from tidegraph.sources.graph import TripleStore
from tidegraph.sources.series import Bound, InconsistentDatatype, SeriesError, SeriesSource
from tidegraph.sparql import algebra as A
from tidegraph.terms import XSD, Iri, Literal, Var, literal_column, spark_type

#: Solutions of the graph part are broadcast to the series up to this number of rows; beyond it they are joined by shuffling.
MOST_BROADCAST = 100_000
#: Up to this number of series ids the scan is also told the ids, for sources that skip data by them.
MOST_PUSHED_IDS = 64
_TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}


@dataclass
class Solutions:
    """A frame with a column for each variable (under its name) and the variables that may be unbound."""

    df: DataFrame
    nullable: set[str] = field(default_factory=set)

    @property
    def names(self) -> list[str]:
        return self.df.columns


@dataclass
class Found:
    """What the graph's solutions say of a series variable."""

    name: str
    rows: int
    series: int
    known: DataFrame
    few: list[str] | None
    least: str | None
    most: str | None
    first: bool = True  # whether the solutions hold no readings yet


@dataclass
class Options:
    vocabulary: str = "urn:tidegraph:series#"
    functions: dict[str, Callable[..., Typed]] = field(default_factory=dict)
    aggregates: dict[str, Callable[[Column, Sequence[str]], Column]] = field(default_factory=dict)
    nulls_last: bool = True


def _linear(e: A.Expr) -> tuple[dict[A.Expr, int], int]:
    """A sum as the number of times each of its terms is added, and the whole constant."""
    if isinstance(e, A.Op) and e.name in ("+", "-", "neg", "pos"):
        out, at = {}, 0
        for i, x in enumerate(e.args):
            sign = -1 if e.name == "neg" or e.name == "-" and i else 1
            terms, n = _linear(x)
            at += sign * n
            for k, m in terms.items():
                out[k] = out.get(k, 0) + sign * m
        return out, at
    if isinstance(e, A.Const) and isinstance(e.term, Literal) and isinstance(spark_type(e.term.datatype), WHOLE):
        try:
            return {}, int(e.term.lexical)
        except ValueError:
            pass
    return {e: 1}, 0


def _period(e: A.Expr, vocabulary: str) -> int | None:
    """The whole seconds k of a period written as FLOOR(seconds since 1970 / k), with or without a cast around it or k times it."""
    k = lambda x: int(float(x.term.lexical)) if isinstance(x, A.Const) and isinstance(x.term, Literal) and x.term.lexical.replace(".", "", 1).isdigit() and float(x.term.lexical) % 1 == 0 else None
    if isinstance(e, A.Op) and e.name == "*" and len(e.args) == 2:
        inner, factor = (e.args if not isinstance(e.args[0], A.Const) else e.args[::-1])
        period = _period(inner, vocabulary)
        return period if period and period == k(factor) else None
    if isinstance(e, A.Call) and e.name in (XSD + "integer", XSD + "long") and len(e.args) == 1:
        return _period(e.args[0], vocabulary)
    if isinstance(e, A.Call) and e.name == "FLOOR" and isinstance(e.args[0], A.Op) and e.args[0].name == "/":
        count, size = e.args[0].args
        return k(size) if isinstance(count, A.Call) and count.name == vocabulary + "DateTimeAsSeconds" and isinstance(count.args[0], A.Ref) else None
    return None


def _subsets(names: Sequence[str]) -> list[set[str] | None]:
    """All sets of the variables that may be unbound together; None, for no division by them, if they are more than three."""
    return [set(c) for k in range(len(names) + 1) for c in combinations(names, k)] if len(names) <= 3 else [None]


def _where_unbound(df: DataFrame, names: Sequence[str], unbound: set[str] | None) -> DataFrame:
    """The rows in which of these columns exactly the unbound are null; all rows for None."""
    for n in names if unbound is not None else ():
        df = df.where(col(n).isNull() if n in unbound else col(n).isNotNull())
    return df


def _has_exists(e: object) -> bool:
    parts = [*(getattr(e, "args", None) or ()), *([e.of, *e.among] if isinstance(e, A.In) else ())]
    return isinstance(e, A.Exists) or any(map(_has_exists, parts))


class Compiler:
    """Compiles one query. Nothing runs but small lookups in the graph: kinds of objects, and the number and datatype of series."""

    def __init__(self, store: TripleStore, series: SeriesSource | None, options: Options) -> None:
        self.store, self.series, self.options = store, series, options
        self.spark = store.spark
        self.spool = Spool(store.spark)
        self.count = 0
        self.meta: set[str] = set()
        self.subjects: set[str] = set()
        self.bounds: dict[str, list[Bound]] = {}
        self.graph: object = None
        self.inner = 0  # depth within OPTIONAL, MINUS and EXISTS

    def run(self, node: A.Node) -> DataFrame:
        predicates: set[str] = set()
        self._survey(node, predicates)
        self.store.learn(predicates)
        return self.compile(node).df

    # survey -------------------------------------------------------------------------------------

    def _survey(self, node: A.Node, predicates: set[str]) -> None:
        """Collects predicates, variables in subject position, and those whose language or datatype is asked for."""

        def of_expr(e: object) -> None:
            if isinstance(e, A.Call) and e.name in ("LANG", "DATATYPE", "ISLITERAL", "ISIRI", "ISURI", "ISBLANK"):
                self.meta |= A.references(e)
            if isinstance(e, A.Exists):
                of_node(e.of)
            for x in getattr(e, "args", ()) or ():
                of_expr(x)
            if isinstance(e, A.In):
                for x in (e.of, *e.among):
                    of_expr(x)
            if isinstance(e, A.Aggregate) and e.arg is not None:
                of_expr(e.arg)

        def of_node(n: A.Node) -> None:
            if isinstance(n, A.Bgp):
                for t in n.triples:
                    if isinstance(t.p, Iri):
                        predicates.add(t.p.value)
                    self.subjects |= {v.name for v in (t.s, t.p) if isinstance(v, Var)}
            for x in vars(n).values():
                for y in x if isinstance(x, list) else [x]:
                    for z in y if isinstance(y, tuple) else [y]:
                        if isinstance(z, A.Node):
                            of_node(z)
                        elif isinstance(z, A.Expr):
                            of_expr(z)

        of_node(node)
        voc = self.options.vocabulary
        if voc + "hasDataPoint" in predicates:
            predicates |= {voc + "hasExternalId", voc + "hasDatatype"}

    # helpers ------------------------------------------------------------------------------------

    def fresh(self) -> str:
        self.count += 1
        return f"__c{self.count}"

    def expressions(self, sol: Solutions, outer: Callable[[str], Typed | None] | None = None) -> Expressions:
        schema = {f.name: f.dataType for f in sol.df.schema}

        def column(name: str) -> Typed | None:
            if name in schema:
                return col(name), schema[name]
            return outer(name) if outer else None

        return Expressions(column, self.store.name, lambda e: self._exists(e, sol), self.options.functions)

    def _align(self, a: Solutions, b: Solutions, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        """Brings columns of both sides to one type: the wider of two numbers, else text."""
        left, right = a.df, b.df
        for n in names:
            ta, tb = left.schema[n].dataType, right.schema[n].dataType
            if ta == tb:
                continue
            if isinstance(ta, T.NullType) or isinstance(tb, T.NullType):
                kind = tb if isinstance(ta, T.NullType) else ta
            elif isinstance(ta, NUMERIC) and isinstance(tb, NUMERIC):
                kind = T.LongType() if isinstance(ta, WHOLE) and isinstance(tb, WHOLE) else T.DoubleType()
            else:
                kind = T.StringType()
            left, right = left.withColumn(n, col(n).cast(kind)), right.withColumn(n, col(n).cast(kind))
        return left, right

    def _shared(self, a: Solutions, b: Solutions) -> list[str]:
        return [n for n in a.names if n in b.names and "@" not in n]

    # nodes --------------------------------------------------------------------------------------

    def compile(self, node: A.Node) -> Solutions:
        return getattr(self, "_" + type(node).__name__.lower())(node)

    def _bgp(self, node: A.Bgp) -> Solutions:
        voc = self.options.vocabulary
        kinds = {voc + k: k for k in ("hasDataPoint", "hasValue", "hasTimestamp")}
        static, points = [], {}
        owner: dict[object, object] = {}
        for t in node.triples:
            kind = kinds.get(t.p.value) if isinstance(t.p, Iri) else None
            if kind == "hasDataPoint":
                points.setdefault(t.o, {})
                if owner.setdefault(t.o, t.s) != t.s:
                    raise SeriesError(f"{t.o} is a data point of two series")
            elif kind:
                points.setdefault(t.s, {}).setdefault(kind, []).append(t.o)
            else:
                static.append(t)
        ids: dict[object, str] = {}
        for s in dict.fromkeys(owner.values()):
            ids[s] = self.fresh()
            named = next((t.o for t in static if t.s == s and isinstance(t.p, Iri) and t.p.value == voc + "hasExternalId" and isinstance(t.o, Var)), None)
            static += [] if named else [A.Triple(s, Iri(voc + "hasExternalId"), Var(ids[s]))]
            ids[s] = named.name if named else ids[s]
            static.append(A.Triple(s, Iri(voc + "hasDatatype"), Var(ids[s] + "_dt")))
        sols = [self._part(*p, points, {k: ids.get(v) for k, v in owner.items()}) for p in self._components(static, points, owner)]
        sol = sols.pop(0) if sols else Solutions(self.spark.range(1).select())
        while sols:
            # parts that only readings connect are joined on what they share, such as a timestamp, once each has its readings
            near = next((x for x in sols if set(x.names) & set(sol.names)), sols[0])
            sols.remove(near)
            sol = self._joined(sol, near, "inner", None)
        return sol

    def _components(self, static: list[A.Triple], points: dict[object, dict], owner: dict[object, object]) -> list[tuple[list[A.Triple], list[object]]]:
        """The parts of a basic pattern that no variable of the graph connects, each with its data points."""
        groups: list[tuple[set, list[A.Triple], list[object]]] = []
        terms = lambda t: {x for x in (t.s, t.p, t.o) if isinstance(x, Var)} | {x for x in (t.s,) if x in owner.values()}
        for own, triples, dps in [*((terms(t), [t], []) for t in static), *(({owner[d]} if d in owner else {d}, [], [d]) for d in points)]:
            met = [g for g in groups if g[0] & own]
            groups = [g for g in groups if not g[0] & own]
            groups.append((own.union(*(g[0] for g in met)), [t for g in met for t in g[1]] + triples, [d for g in met for d in g[2]] + dps))
        return [g[1:] for g in groups]

    def _part(self, static: list[A.Triple], dps: list[object], points: dict[object, dict], ids: dict[object, str]) -> Solutions:
        """One connected part of a basic pattern: the graph's solutions, joined with the readings of its data points."""
        sol = self._static(static)
        names = list(dict.fromkeys(ids[d] for d in dps if d in ids))
        found: dict[str, Found] = {}
        if names:
            # written once: it is counted, tells the series' ids and datatypes, and is joined
            base, _ = self.spool.write(sol.df)
            sol = Solutions(base, sol.nullable)
            found = self._found(base, names)
        for dp in dps:
            sol = self._points(sol, dp, points[dp], found.get(ids.get(dp)))
            found = {k: replace(f, first=False) for k, f in found.items()}
        own = {n for i in names for n in (i, i + "_dt") if n.startswith("__c")}
        return Solutions(sol.df.drop(*own), sol.nullable) if own else sol

    def _found(self, base: DataFrame, names: list[str]) -> dict[str, Found]:
        """How many rows the graph's solutions have, and of each series variable how many ids and which datatypes."""
        counts = [F.count(F.lit(1)).alias("rows")]
        for n in names:
            counts += [F.count_distinct(col(n)).alias(n), F.min(col(n + "_dt")).alias(n + "_least"), F.max(col(n + "_dt")).alias(n + "_most")]
        r = base.agg(*counts).first()
        out = {}
        for n in names:
            known = base.select(col(n).cast("string").alias("i"), col(n + "_dt").alias("d")).distinct()
            few = [x["i"] for x in known.select("i").distinct().collect()] if r[n] <= MOST_PUSHED_IDS else None
            out[n] = Found(n, r["rows"], r[n], known, few, r[n + "_least"], r[n + "_most"])
        return out

    def _static(self, triples: list[A.Triple]) -> Solutions:
        """Joins triple patterns, those with more constants first, each one connected with those before where possible."""
        if not triples:
            return Solutions(self.spark.range(1).select())
        left = sorted(dict.fromkeys(triples), key=lambda t: -sum((2 if x is t.o or x is t.s else 1) for x in (t.s, t.p, t.o) if not isinstance(x, Var)) + 4 * (not isinstance(t.p, (Iri, Var))))
        out: DataFrame | None = None
        types: dict[str, T.DataType] = {}
        while left:
            names = lambda t: {v.name for v in (t.s, t.p, t.o) if isinstance(v, Var)}
            t = next((t for t in left if names(t) & types.keys()), left[0])
            left.remove(t)
            typed = not (isinstance(t.o, Var) and t.o.name in self.subjects)
            scan, own = self.store.scan(t, self.graph, typed, self.meta)
            if out is None:
                out, types = scan, own
                continue
            shared = [n for n in own if n in types and "@" not in n]
            if any(own[n] != types[n] for n in shared):
                out, scan = self._align(Solutions(out), Solutions(scan), shared)
                own = {f.name: f.dataType for f in scan.schema}
            known = [n for n in own if "@" in n and n in types]
            scan = scan.drop(*known) if known else scan
            out = out.join(scan, shared) if shared else out.crossJoin(scan)
            types |= own
        return Solutions(out)

    def _points(self, sol: Solutions, dp: object, parts: dict[str, list], found: Found | None) -> Solutions:
        """Joins the readings that a data point stands for."""
        if self.series is None:
            raise SeriesError("no series source is set")
        if not isinstance(dp, Var):
            raise SeriesError("a data point must be a variable")
        bounds = [b for v in parts.get("hasTimestamp", ()) if isinstance(v, Var) for b in self.bounds.get(v.name, ())]
        if found is None:
            frame = self.series.scan(None, bounds)
        elif found.least == found.most:
            frame = self.series.scan(found.least, bounds)
        elif self.inner:
            # the rows outside decide which of the series matter, so each datatype is read from its own table
            frame = self._all_types([r["d"] for r in found.known.select("d").distinct().orderBy("d").collect()], bounds)
        else:
            raise InconsistentDatatype(f"the series of {dp} are of datatypes {found.least} and {found.most}")
        if found and found.few is not None:
            frame = frame.where(F.col("id").isin(found.few))
        mixed = "datatype" in frame.columns
        if not isinstance(frame.schema["timestamp"].dataType, T.TimestampType):
            frame = frame.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        columns = {dp.name: F.concat(F.col("id"), F.lit("#"), F.unix_micros("timestamp").cast("string"))}
        for kind, source in (("hasValue", "value"), ("hasTimestamp", "timestamp")):
            for v in parts.get(kind, ()):
                if isinstance(v, Literal):
                    frame = frame.where(F.col(source) == literal_column(v))
                elif isinstance(v, Var):
                    if v.name in columns:
                        frame = frame.where(F.col(source) == columns[v.name])
                    columns[v.name] = F.col(source)
        key = found.name if found else self.fresh()
        frame = frame.where(F.col("id").isNotNull() & F.col("timestamp").isNotNull() & F.col("value").isNotNull())
        frame = frame.select(F.col("id").cast("string").alias(key), *([F.col("datatype").alias(f"{key}_dt")] if mixed else []), *(c.alias(n) for n, c in columns.items()))
        shared = [n for n in columns if n in sol.df.columns]
        left, frame = self._align(sol, Solutions(frame), shared)
        if found is None:
            frame = frame.drop(key)
            return Solutions(frame if not left.columns else left.join(frame, shared) if shared else left.crossJoin(frame), sol.nullable)
        left = left.withColumn(key, col(key).cast("string"))
        on = [key, *([f"{key}_dt"] if mixed else []), *shared]
        if found.first and found.rows <= MOST_BROADCAST:
            return Solutions(frame.join(F.broadcast(left), on), sol.nullable)
        if not found.first and found.series <= MOST_BROADCAST:
            # the left side has readings already: the series in question are picked before the shuffle
            frame = frame.join(F.broadcast(found.known.select(F.col("i").alias(key)).distinct()), key, "left_semi")
        return Solutions(frame.join(left, on), sol.nullable)

    def _all_types(self, datatypes: list[str], bounds: Sequence[Bound]) -> DataFrame:
        frames = [self.series.scan(d, bounds).withColumn("datatype", F.lit(d)) for d in datatypes]
        types = [f.schema["value"].dataType for f in frames]
        kind = T.LongType() if all(isinstance(t, WHOLE) for t in types) else T.DoubleType() if all(isinstance(t, NUMERIC) for t in types) else T.StringType()
        return reduce(DataFrame.unionByName, (f.withColumn("value", F.col("value").cast(kind)) for f in frames))

    def _bounded_by(self, names: Iterable[str], node: A.Node) -> Solutions:
        """Compiles a node below which only the bounds on these variables may keep readings from being scanned."""
        held = self.bounds
        self.bounds = {n: held[n] for n in names if n in held}
        try:
            return self.compile(node)
        finally:
            self.bounds = held

    def _inside(self, node: A.Node, outer: Solutions) -> Solutions:
        """The inside of OPTIONAL, MINUS and EXISTS: leaving out a row there may add one outside, unless the outside is bounded itself."""
        self.inner += 1
        try:
            return self._bounded_by(set(outer.names) - outer.nullable, node)
        finally:
            self.inner -= 1

    def _join(self, node: A.Join) -> Solutions:
        return self._joined(self.compile(node.left), self.compile(node.right), "inner", None)

    def _joined(self, a: Solutions, b: Solutions, how: str, cond: A.Expr | None, extends: Sequence[tuple[Var, A.Expr]] = ()) -> Solutions:
        """An inner or left join on compatible values of the shared variables, with a condition over both sides."""
        shared = self._shared(a, b)
        left, right = self._align(a, b, shared)
        other = {n: self.fresh() for n in shared}
        extra = [n for n in right.columns if n in left.columns and "@" in n]
        mark = self.fresh()
        right = right.drop(*extra).withColumnsRenamed(other).withColumn(mark, F.lit(True))
        extra_on: Column | None = None
        rest = [n for n in right.columns if n not in other.values() and n != mark]
        if cond is not None:
            schema = {f.name: f.dataType for f in (*right.schema, *left.schema)}
            seen = lambda n: F.coalesce(col(n), col(other[n])) if n in shared and n in a.nullable else col(n)
            e = Expressions(lambda n: (seen(n), schema[n]) if n in schema else None, self.store.name, lambda x: self._exists(x, Solutions(left.crossJoin(right))), self.options.functions)
            extra_on = e.flag(cond)
            near = self._near(cond, e, set(left.columns) - (set(shared) & a.nullable), set(rest))
            if near:
                bucket = self.fresh()
                right = right.withColumn(bucket, F.explode(near[1]))
                extra_on = (near[0] == col(bucket)) & extra_on
        # a variable unbound on one side fits any value: such rows are joined apart from the others, so that each join keeps its equalities
        apart, unsure = [n for n in shared if n in a.nullable], [n for n in shared if n in b.nullable]
        out = [F.coalesce(col(n), col(other[n])).alias(n) if n in apart else col(n) for n in left.columns]
        kinds = right.schema
        parts = []
        for unbound in _subsets(apart):
            rows = _where_unbound(left, apart, unbound)
            pieces = []
            for missing in _subsets(unsure):
                on = F.lit(True) if extra_on is None else extra_on
                for n in shared:
                    if n in (unbound or ()) or n in (missing or ()):
                        continue
                    same = col(n) == col(other[n])
                    same = same | col(n).isNull() if unbound is None and n in apart else same
                    on = on & (same | col(other[n]).isNull() if missing is None and n in unsure else same)
                pieces.append((_where_unbound(right, [other[n] for n in unsure], missing and {other[n] for n in missing}), on))
            inner = how == "inner" or len(pieces) > 1
            for piece, on in pieces:
                joined = rows.join(piece, on, "inner" if inner else "left") if shared or cond is not None or not inner else rows.crossJoin(piece)
                parts.append(joined.select(*out, *map(col, rest), col(mark)))
            if how == "left" and inner:
                alone = reduce(lambda d, p: d.join(p[0], p[1], "left_anti"), pieces, rows)
                parts.append(alone.select(*left.columns, *(F.lit(None).cast(kinds[n].dataType).alias(n) for n in (*rest, mark))))
        nullable = (a.nullable - set(shared)) | {n for n in apart if n in b.nullable or how == "left"} | (b.nullable - set(shared)) | (set(rest) if how == "left" else set())
        sol = Solutions(reduce(DataFrame.unionByName, parts), nullable)
        for var, e in extends:
            c = self.expressions(sol).typed(e)[0]
            sol = Solutions(sol.df.withColumn(var.name, F.when(col(mark), c)), sol.nullable | {var.name})
        return Solutions(sol.df.drop(mark), sol.nullable)

    def _near(self, cond: A.Expr, e: Expressions, lefts: set[str], rights: set[str]) -> tuple[Column, Column] | None:
        """Of a condition that bounds the difference of a whole number on the right and one on the left: the bucket of a left row, and both of a right one.

        A bucket is as wide as the bounds are apart, so a left row finds its partners in its own bucket and the next one.
        """
        spans: dict[tuple[A.Expr, A.Expr], dict[str, list[int]]] = {}
        for c in A.conjuncts(cond):
            if not (isinstance(c, A.Op) and c.name in ("<", "<=", ">", ">=")):
                continue
            terms, at = _linear(A.Op("-", c.args))
            terms = {k: n for k, n in terms.items() if n}
            if sorted(terms.values()) != [-1, 1]:
                continue
            plus, minus = sorted(terms, key=terms.get, reverse=True)
            name, at = c.name, -at
            if A.references(plus) <= lefts:
                plus, minus, name, at = minus, plus, _TURNED[name], -at
            if A.references(plus) and A.references(plus) <= rights and A.references(minus) and A.references(minus) <= lefts and all(isinstance(e.typed(x)[1], WHOLE) for x in (plus, minus)):
                spans.setdefault((plus, minus), {}).setdefault(name[0], []).append(at + (name == ">") - (name == "<"))
        known = [(max(1, min(s["<"]) - max(s[">"])), max(s[">"]), k) for k, s in spans.items() if len(s) == 2]
        if not known or not all(-(1 << 62) < x < 1 << 62 for k in known for x in k[:2]):
            return None
        width, low, (plus, minus) = min(known, key=lambda k: k[0])
        floor = lambda x: F.call_function("div", x, F.lit(width).cast("bigint")) - (x % width < 0).cast("int")
        x, y = (e.typed(k)[0].cast("bigint") for k in (plus, minus))
        least = F.when(y.isNotNull(), F.coalesce(F.try_add(y, F.lit(low).cast("bigint")), F.lit(-(1 << 63)).cast("bigint")))
        return floor(least), F.array(floor(x), floor(x) - 1)

    def _leftjoin(self, node: A.LeftJoin) -> Solutions:
        """OPTIONAL; BIND and FILTER at the top of its right side see the variables of the left one."""
        left = self.compile(node.left)
        inner, extends, conds = node.right, [], [node.cond] if node.cond is not None else []
        inside = lambda n: set(A.variables(n))
        while isinstance(inner, (A.Extend, A.Filter)):
            e = inner.expr if isinstance(inner, A.Extend) else inner.cond
            if A.references(e) <= inside(inner.of):
                break
            if isinstance(inner, A.Extend):
                extends.insert(0, (inner.var, e))
            else:
                conds.append(e)
            inner = inner.of
        by: dict[str, A.Expr] = {}
        for var, e in extends:
            by[var.name] = A.substituted(e, by)
        conds = [A.substituted(c, by) for c in conds]
        cond = reduce(lambda a, b: A.Op("&&", (a, b)), conds) if conds else None
        if isinstance(inner, A.Bgp) and not inner.triples:
            # nothing to match: the left row itself tells whether the optional part holds, without a join
            e = self.expressions(left)
            holds = F.coalesce(e.flag(cond), F.lit(False)) if cond is not None else F.lit(True)
            made = [F.when(holds, e.typed(by[v.name])[0]).alias(v.name) for v, _ in extends if v.name not in left.names]
            return Solutions(left.df.select("*", *made), left.nullable | {v.name for v, _ in extends})
        return self._joined(left, self._inside(inner, left), "left", cond, extends)

    def _minus(self, node: A.Minus) -> Solutions:
        a = self.compile(node.left)
        within = self._within(node.left, node.right)
        if within is not None:
            return Solutions(a.df.where(~F.coalesce(self.expressions(a).flag(within), F.lit(False))), a.nullable)
        b = self._inside(node.right, a)
        shared = self._shared(a, b)
        if not shared:
            return a
        left, right = self._align(a, b, shared)
        right = right.select(*shared).distinct()
        maybe = [n for n in shared if n in a.nullable | b.nullable]
        if not maybe:
            return Solutions(left.join(right, shared, "left_anti"), a.nullable)
        sure = [n for n in shared if n not in maybe]
        other = {n: self.fresh() for n in shared}
        right = right.withColumnsRenamed(other)
        # rows are told apart by what is bound on either side; each kind is held against each by equality of what both have
        parts = []
        for unbound in _subsets([n for n in maybe if n in a.nullable]):
            rows = _where_unbound(left, [n for n in maybe if n in a.nullable], unbound)
            for missing in _subsets([n for n in maybe if n in b.nullable]):
                piece = _where_unbound(right, [other[n] for n in maybe if n in b.nullable], missing and {other[n] for n in missing})
                if unbound is None or missing is None:
                    on, some = F.lit(True), F.lit(bool(sure))
                    for n in shared:
                        l, r = col(n), col(other[n])
                        on, some = on & (l == r if n in sure else (l == r) | l.isNull() | r.isNull()), some | F.coalesce(l == r, F.lit(False))
                    rows = rows.join(piece, on & some, "left_anti")
                    continue
                both = [n for n in shared if n not in unbound | missing]
                if both:
                    rows = rows.join(piece.select(*(other[n] for n in both)).distinct(), reduce(lambda x, y: x & y, (col(n) == col(other[n]) for n in both)), "left_anti")
            parts.append(rows)
        return Solutions(reduce(DataFrame.unionByName, parts), a.nullable)

    def _within(self, left: A.Node, right: A.Node) -> A.Expr | None:
        """The condition that a row of the left must not meet where MINUS repeats some of the left's own triples under it: no join is needed then."""
        conds = []
        while isinstance(right, A.Filter):
            conds.append(right.cond)
            right = right.of
        while isinstance(left, (A.Filter, A.Extend)):
            left = left.of
        if not (conds and isinstance(left, A.Bgp) and isinstance(right, A.Bgp) and right.triples and set(right.triples) <= set(left.triples)):
            return None
        cond = reduce(lambda x, y: A.Op("&&", (x, y)), conds)
        names = {n for t in right.triples for n in A.variables(A.Bgp([t]))}
        plain = all(isinstance(t.p, Iri) for t in right.triples) and not _has_exists(cond)
        return cond if names and plain and A.references(cond) <= names else None

    def _union(self, node: A.Union) -> Solutions:
        a, b = self.compile(node.left), self.compile(node.right)
        left, right = self._align(a, b, [n for n in a.names if n in b.names])
        one_sided = set(a.names) ^ set(b.names)
        return Solutions(left.unionByName(right, allowMissingColumns=True), a.nullable | b.nullable | one_sided)

    def _filter(self, node: A.Filter) -> Solutions:
        held = self.bounds
        self.bounds = {k: list(v) for k, v in held.items()}
        for c in A.conjuncts(node.cond):
            self._note_bound(c)
        of = self.compile(node.of)
        self.bounds = held
        cond = self.expressions(of).flag(node.cond)
        never = {n for c in A.conjuncts(node.cond) if isinstance(c, A.Op) and c.name in _TURNED for n in A.references(c)}
        return Solutions(of.df.where(cond), of.nullable - never)

    def _note_bound(self, c: A.Expr) -> None:
        """Notes a comparison of a variable with a constant time, for scans that can skip data by it."""
        if not (isinstance(c, A.Op) and c.name in _TURNED and len(c.args) == 2):
            return
        a, b, op = *c.args, c.name
        if isinstance(a, A.Const):
            a, b, op = b, a, _TURNED[op]
        if isinstance(a, A.Ref) and isinstance(b, A.Const) and isinstance(b.term, Literal) and isinstance(spark_type(b.term.datatype), T.TimestampType):
            try:
                at = datetime.fromisoformat(b.term.lexical)
            except ValueError:
                return
            at = at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at
            self.bounds.setdefault(a.var.name, []).append((op, at))

    def _extend(self, node: A.Extend) -> Solutions:
        of = self.compile(node.of)
        if node.var.name in of.names:
            return of
        value, kind = self.expressions(of).typed(node.expr)
        e, df = node.expr, of.df.withColumn(node.var.name, value)
        if node.var.name in self.meta and isinstance(e, A.Call) and e.name in ("STRLANG", "STRDT") and f"{node.var.name}@lang" not in of.names:
            tag = self.expressions(of).typed(e.args[1])[0].cast("string")
            tags = {"lang": tag, "dt": F.lit("rdf:langString")} if e.name == "STRLANG" else {"lang": F.lit(""), "dt": tag}
            df = df.withColumns({f"{node.var.name}@{k}": F.when(value.isNotNull(), c) for k, c in tags.items()} | {f"{node.var.name}@literal": F.lit(True)})
        safe = isinstance(e, A.Const) or isinstance(e, A.Ref) and e.var.name in of.names and e.var.name not in of.nullable
        return Solutions(df, of.nullable | (set() if safe else {node.var.name}))

    def _values(self, node: A.Values) -> Solutions:
        names = [v.name for v in node.names]
        columns, kinds = [], []
        for i in range(len(names)):
            terms = [r[i] for r in node.rows if r[i] is not None]
            types = {type(spark_type(t.datatype)) if isinstance(t, Literal) else T.StringType for t in terms}
            kind = spark_type(next(t for t in terms if isinstance(t, Literal)).datatype) if len(types) == 1 and T.StringType not in types and None not in types else T.DoubleType() if types and all(k in NUMERIC for k in types) else T.StringType()
            kinds.append(kind)
            columns.append([None if r[i] is None else r[i].lexical if isinstance(r[i], Literal) else self.store.name(r[i].value) for r in node.rows])
        ddl = T.StructType([T.StructField(n, T.StringType()) for n in names])
        rows = self.spark.createDataFrame(list(zip(*columns)) if names else [()] * len(node.rows), ddl)
        unbound = {n for n, c in zip(names, columns) if None in c}
        # a constant of the query's text
        return Solutions(F.broadcast(rows.select(*(col(n).cast(k).alias(n) for n, k in zip(names, kinds)))), unbound)

    def _graph(self, node: A.Graph) -> Solutions:
        held, self.graph = self.graph, node.name
        out = self.compile(node.of)
        self.graph = held
        return out

    def _group(self, node: A.Group) -> Solutions:
        asked = self._processed(node)
        if asked is not None:
            held, self.series = self.series, asked
            try:
                sums = [(v, replace(a, name="SUM" if a.name == "COUNT" else a.name)) for v, a in node.aggregates]
                return self._group(A.Group(node.of, node.keys, sums))
            finally:
                self.series = held
        of = self._bounded_by([k.name for k in node.keys], node.of)
        e = self.expressions(of)
        times = [f.name for f in of.df.schema if isinstance(f.dataType, T.TimestampType)]
        visible = [n for n in of.names if "@" not in n and not n.startswith("__")]
        made = [aggregate(a, None if a.arg is None else e.typed(a.arg), visible, times, self.options.aggregates).alias(v.name) for v, a in node.aggregates]
        keys = [k.name for k in node.keys if k.name in of.names]
        lost = [k.name for k in node.keys if k.name not in of.names]
        if made:
            df = of.df.groupBy(*map(col, keys)).agg(*made) if keys else of.df.agg(*made)
        else:
            df = of.df.select(*map(col, keys)).distinct()
        for n in lost:
            df = df.withColumn(n, F.lit(None).cast("string"))
        return Solutions(df, (of.nullable & set(keys)) | set(lost) | {v.name for v, a in node.aggregates if a.name not in ("COUNT", "SUM")})

    def _processed(self, node: A.Group) -> SeriesSource | None:
        """A source of aggregates over intervals, where the series' own source gives such and the group asks for no more.

        That is one SUM, COUNT, MIN or MAX of the values of one data point by whole periods of its time and by names of the graph, and no
        condition but bounds of the time that lie on periods. The aggregates of several series of a group are then aggregated again.
        """
        if not hasattr(self.series, "scan_processed") or len(node.aggregates) != 1:
            return None
        a = node.aggregates[0][1]
        if a.name not in ("SUM", "COUNT", "MIN", "MAX") or a.distinct or not isinstance(a.arg, A.Ref):
            return None
        inner, extends, conds = node.of, [], []
        while isinstance(inner, (A.Extend, A.Filter)):
            if isinstance(inner, A.Extend):
                extends.append(inner)
            else:
                conds += A.conjuncts(inner.cond)
            inner = inner.of
        voc = self.options.vocabulary
        of = lambda k: [t for t in inner.triples if isinstance(t.p, Iri) and t.p.value == voc + k]
        if not isinstance(inner, A.Bgp) or any(len(of(k)) != 1 for k in ("hasDataPoint", "hasValue", "hasTimestamp")):
            return None
        dp, value, time = of("hasDataPoint")[0].o, of("hasValue")[0].o, of("hasTimestamp")[0].o
        used = [t for t in inner.triples if {dp, value, time} & {t.s, t.o}]
        if value != a.arg.var or len(used) != 3 or not isinstance(time, Var) or len(extends) != 1 or A.references(extends[0].expr) != {time.name}:
            return None
        seconds = _period(extends[0].expr, voc)
        keys = {k.name for k in node.keys}
        if not seconds or extends[0].var.name not in keys or keys & {v.name for v in (dp, value, time) if isinstance(v, Var)}:
            return None
        for c in conds:
            held, self.bounds = self.bounds, {}
            self._note_bound(c)
            bounds, self.bounds = self.bounds.get(time.name, []), held
            on = [op in (">=", "<") and (at - datetime(1970, 1, 1)) % timedelta(seconds=seconds) == timedelta() for op, at in bounds]
            if not on or not all(on):
                return None
        source = self.series

        class Processed:
            def scan(self, datatype: str | None, bounds: Sequence[Bound] = ()) -> DataFrame:
                return source.scan_processed(datatype, bounds, a.name, seconds)

        return Processed() if source.scan_processed(None, [("<", datetime(1970, 1, 1))], a.name, seconds) is not None else None

    def _orderby(self, node: A.OrderBy) -> Solutions:
        of = self.compile(node.of)
        e = self.expressions(of)
        keys = []
        for expr, down in node.keys:
            c = e.typed(expr)[0]
            last = self.options.nulls_last
            keys.append(c.desc_nulls_last() if down else c.asc_nulls_last() if last else c.asc_nulls_first())
        return Solutions(of.df.orderBy(*keys), of.nullable)

    def _project(self, node: A.Project) -> Solutions:
        names = [v.name for v in node.names]
        of = self._bounded_by(names, node.of)
        keep = [col(n) if n in of.names else F.lit(None).cast("string").alias(n) for n in dict.fromkeys(names)]
        return Solutions(of.df.select(*keep), (of.nullable & set(names)) | {n for n in names if n not in of.names})

    def _distinct(self, node: A.Distinct) -> Solutions:
        of = self.compile(node.of)
        return Solutions(of.df.distinct(), of.nullable)

    def _reduced(self, node: A.Reduced) -> Solutions:
        return self.compile(node.of)

    def _slice(self, node: A.Slice) -> Solutions:
        of = self._bounded_by((), node.of)
        df = of.df.offset(node.offset) if node.offset else of.df
        return Solutions(df if node.limit is None else df.limit(node.limit), of.nullable)

    # existence ----------------------------------------------------------------------------------

    def _exists(self, e: A.Exists, outer: Solutions) -> Column:
        """A subquery correlated on the shared variables; filters at its top may also mention other variables of the outside."""
        inner, conds = e.of, []
        while isinstance(inner, A.Filter) and not A.references(inner.cond) <= set(A.variables(inner.of)):
            conds.append(inner.cond)
            inner = inner.of
        sol = self._inside(inner, outer)
        shared = self._shared(outer, sol)
        inside = {n: self.fresh() for n in sol.names}
        schema = {f.name: f.dataType for f in sol.df.schema}
        outer_schema = {f.name: f.dataType for f in outer.df.schema}
        # the alias keeps names of the outside from being looked up below it
        df = sol.df.withColumnsRenamed(inside).alias(self.fresh())
        column = lambda n: (col(inside[n]), schema[n]) if n in schema else (col(n).outer(), outer_schema[n]) if n in outer_schema else None
        ex = Expressions(column, self.store.name, lambda x: self._exists(x, sol), self.options.functions)
        apart, unsure = [n for n in shared if n in outer.nullable], [n for n in shared if n in sol.nullable]
        tests: list[Column] = []
        for unbound in _subsets(apart):
            for missing in _subsets(unsure):
                part = _where_unbound(df, [inside[n] for n in unsure], missing and {inside[n] for n in missing})
                for n in shared:
                    if n in (unbound or ()) or n in (missing or ()):
                        continue
                    a, b = col(inside[n]), col(n).outer()
                    if schema[n] != outer_schema[n] and (isinstance(schema[n], T.StringType) or isinstance(outer_schema[n], T.StringType)):
                        a, b = a.cast("string"), b.cast("string")
                    same = a == b
                    same = same | a.isNull() if missing is None and n in unsure else same
                    part = part.where(same | b.isNull() if unbound is None and n in apart else same)
                for c in conds:
                    part = part.where(ex.flag(c))
                here = part.exists()
                for n in apart if unbound is not None else ():
                    here = (col(n).isNull() if n in unbound else col(n).isNotNull()) & here
                tests.append(here)
        return reduce(lambda x, y: x | y, tests)
