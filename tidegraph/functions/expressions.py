"""Expressions to columns. Errors give null, as an expression in error is unbound."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.sparql import algebra as A
from tidegraph.terms import XSD, Iri, Literal, literal_column, spark_type

NUMERIC = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.DecimalType)
WHOLE = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


class UnknownFunction(ValueError):
    """A function has no implementation."""


Typed = tuple[Column, T.DataType | None]


def text_of(x: Typed) -> Column:
    """A value's lexical form."""
    c, kind = x
    if isinstance(kind, T.TimestampType):
        return F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0*$", "")
    return c.cast("string")


def _rounded(f: Callable[[Column], Column]):
    def call(x: Typed) -> Typed:
        return x if isinstance(x[1], WHOLE) else (f(x[0].cast("double")).cast("double"), T.DoubleType())

    return call


_text = lambda f: lambda *a: (f(*map(text_of, a)), T.StringType())
_flag = lambda f: lambda *a: (f(*map(text_of, a)), T.BooleanType())
_part = lambda f: lambda x: (f(x[0]), T.IntegerType())


def _regex(text: Typed, pattern: Typed, flags: Typed | None = None) -> Typed:
    p = text_of(pattern) if flags is None else F.concat(F.lit("(?"), text_of(flags), F.lit(")"), text_of(pattern))
    return F.regexp_like(text_of(text), p), T.BooleanType()


def _replace(text: Typed, pattern: Typed, by: Typed, flags: Typed | None = None) -> Typed:
    p = text_of(pattern) if flags is None else F.concat(F.lit("(?"), text_of(flags), F.lit(")"), text_of(pattern))
    return F.regexp_replace(text_of(text), p, text_of(by)), T.StringType()


def _before(text: Column, mark: Column) -> Column:
    at = F.position(mark, text)
    return F.when(at > 1, F.substr(text, F.lit(1), at - 1)).otherwise("")


def _after(text: Column, mark: Column) -> Column:
    at = F.position(mark, text)
    return F.when(F.length(mark) == 0, text).when(at > 0, F.substr(text, at + F.length(mark))).otherwise("")


def _cast(datatype: str):
    kind = spark_type(datatype)

    def call(x: Typed) -> Typed:
        c, of = x
        if isinstance(kind, T.StringType):
            return text_of(x), kind
        if isinstance(kind, WHOLE) and isinstance(of, T.StringType):
            # "3.7" is no integer, but a number in a string may have a fraction of zeros or an exponent
            return c.try_cast("double").try_cast(kind), kind
        return c.try_cast(kind), kind

    return call


def _like(a: Typed, pattern: Typed) -> Typed:
    return F.like(text_of(a), text_of(pattern)), T.BooleanType()


FUNCTIONS: dict[str, Callable[..., Typed]] = {
    "YEAR": _part(F.year), "MONTH": _part(F.month), "DAY": _part(F.day), "HOURS": _part(F.hour), "MINUTES": _part(F.minute), "SECONDS": _part(F.second),
    "ABS": lambda x: (F.abs(x[0]), x[1]), "CEIL": _rounded(F.ceil), "FLOOR": _rounded(F.floor), "ROUND": _rounded(lambda c: F.floor(c + 0.5)),
    "CONCAT": _text(lambda *a: F.concat(*a)), "STR": _text(lambda a: a), "STRLEN": lambda x: (F.length(text_of(x)), T.IntegerType()),
    "UCASE": _text(F.upper), "LCASE": _text(F.lower), "CONTAINS": _flag(F.contains), "STRSTARTS": _flag(F.startswith), "STRENDS": _flag(F.endswith),
    "SUBSTR": lambda x, start, n=None: (F.substr(text_of(x), start[0].cast("int"), *(() if n is None else (n[0].cast("int"),))), T.StringType()),
    "STRBEFORE": _text(_before), "STRAFTER": _text(_after), "REGEX": _regex, "REPLACE": _replace, "ENCODE_FOR_URI": _text(lambda a: F.replace(F.url_encode(a), F.lit("+"), F.lit("%20"))),
    "MD5": _text(F.md5), "SHA1": _text(F.sha1), "SHA256": _text(lambda a: F.sha2(a, 256)), "SHA384": _text(lambda a: F.sha2(a, 384)), "SHA512": _text(lambda a: F.sha2(a, 512)),
    "NOW": lambda: (F.current_timestamp(), T.TimestampType()), "RAND": lambda: (F.rand(), T.DoubleType()), "TZ": lambda x: (F.when(x[0].isNotNull(), F.lit("Z")), T.StringType()),
    "TIMEZONE": lambda x: (F.when(x[0].isNotNull(), F.lit("PT0S")), T.StringType()),
    "IRI": _text(lambda a: a), "URI": _text(lambda a: a), "UUID": lambda: (F.concat(F.lit("urn:uuid:"), F.uuid()), T.StringType()), "STRUUID": lambda: (F.uuid(), T.StringType()),
    "BNODE": lambda x=None: (F.concat(F.lit("_:"), F.uuid() if x is None else text_of(x)), T.StringType()), "STRLANG": _text(lambda a, tag: a),
    "ISNUMERIC": lambda x: (F.lit(isinstance(x[1], NUMERIC)), T.BooleanType()),
} | {XSD + local: _cast(XSD + local) for local in ("string", "boolean", "integer", "int", "long", "short", "byte", "unsignedInt", "double", "decimal", "float", "dateTime", "date")}


def time_functions(vocabulary: str) -> dict[str, Callable[..., Typed]]:
    """Functions of the series vocabulary; nanoseconds are exact to the microsecond."""
    return {
        vocabulary + "DateTimeAsNanos": lambda x: (F.unix_micros(x[0].cast("timestamp")) * 1000, T.LongType()),
        vocabulary + "DateTimeAsSeconds": lambda x: (F.unix_seconds(x[0].cast("timestamp")), T.LongType()),
        vocabulary + "NanosAsDateTime": lambda x: (F.timestamp_micros(F.floor(x[0] / 1000).cast("bigint")), T.TimestampType()),
        vocabulary + "SecondsAsDateTime": lambda x: (F.timestamp_micros((x[0].cast("double") * 1_000_000).cast("bigint")), T.TimestampType()),
        vocabulary + "like": _like,
    }


class Expressions:
    """Compiles expressions against the columns of one frame."""

    def __init__(self, column: Callable[[str], Typed | None], name: Callable[[str], str], exists: Callable[[A.Exists], Column], functions: dict[str, Callable[..., Typed]]) -> None:
        self.column, self.name, self.exists, self.functions = column, name, exists, functions

    def flag(self, e: A.Expr) -> Column:
        """An expression's effective boolean value."""
        c, kind = self.typed(e)
        if isinstance(kind, NUMERIC):
            return c != 0
        if isinstance(kind, T.StringType):
            return F.length(c) > 0
        return c if kind is None or isinstance(kind, T.BooleanType) else F.lit(None).cast("boolean")

    def _aligned(self, a: Typed, b: Typed) -> tuple[Column, Column]:
        """Two values made comparable: text that meets a number, time or truth value is read as such."""
        (x, tx), (y, ty) = a, b
        if isinstance(tx, T.StringType) and ty is not None and not isinstance(ty, (T.StringType, T.NullType)):
            return x.try_cast("double" if isinstance(ty, NUMERIC) else ty), y
        if isinstance(ty, T.StringType) and tx is not None and not isinstance(tx, (T.StringType, T.NullType)):
            return x, y.try_cast("double" if isinstance(tx, NUMERIC) else tx)
        if tx is not None and ty is not None and isinstance(tx, NUMERIC) != isinstance(ty, NUMERIC):
            none = F.lit(None).cast("string")
            return none, none
        return x, y

    def typed(self, e: A.Expr) -> Typed:
        if isinstance(e, A.Ref):
            return self.column(e.var.name) or (F.lit(None), T.NullType())
        if isinstance(e, A.Const):
            if isinstance(e.term, Iri):
                return F.lit(self.name(e.term.value)), T.StringType()
            return literal_column(e.term), spark_type(e.term.datatype)
        if isinstance(e, A.Op):
            return self._operator(e)
        if isinstance(e, A.In):
            one = self.typed(e.of)
            if all(isinstance(x, A.Const) for x in e.among) and e.among:
                pairs = [self._aligned(one, self.typed(x)) for x in e.among]
                if all(p[0] is one[0] for p in pairs):
                    found = one[0].isin([p[1] for p in pairs])
                    return (~found if e.negated else found), T.BooleanType()
            found = F.lit(False)
            for x in e.among:
                a, b = self._aligned(one, self.typed(x))
                found = found | (a == b)
            return (~found if e.negated else found), T.BooleanType()
        if isinstance(e, A.Exists):
            found = self.exists(e)
            return (~found if e.negated else found), T.BooleanType()
        if isinstance(e, A.Call):
            return self._call(e)
        raise UnknownFunction(f"{type(e).__name__} cannot stand here")

    def _operator(self, e: A.Op) -> Typed:
        if e.name in ("||", "&&"):
            a, b = map(self.flag, e.args)
            return (a | b if e.name == "||" else a & b), T.BooleanType()
        if e.name == "!":
            return ~self.flag(e.args[0]), T.BooleanType()
        if e.name in ("neg", "pos"):
            c, kind = self._number(self.typed(e.args[0]))
            return (-c if e.name == "neg" else c), kind
        a, b = map(self.typed, e.args)
        if e.name in ("=", "!=", "<", "<=", ">", ">="):
            x, y = self._aligned(a, b)
            return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[e.name], T.BooleanType()
        (x, tx), (y, ty) = self._number(a), self._number(b)
        if e.name == "/":
            return F.try_divide(x.cast("double"), y.cast("double")), T.DoubleType()
        whole = isinstance(tx, WHOLE) and isinstance(ty, WHOLE)
        if whole:
            x, y = x.cast("bigint"), y.cast("bigint")
        f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[e.name]
        return f(x, y), T.LongType() if whole else T.DoubleType() if tx is not None and ty is not None else None

    def _number(self, x: Typed) -> Typed:
        c, kind = x
        if isinstance(kind, T.StringType):
            return c.try_cast("double"), T.DoubleType()
        if isinstance(kind, T.DecimalType):
            return c.cast("double"), T.DoubleType()
        return (c, kind) if kind is None or isinstance(kind, NUMERIC) else (F.lit(None).cast("double"), T.DoubleType())

    def _call(self, e: A.Call) -> Typed:
        if e.name == "BOUND":
            return self.typed(e.args[0])[0].isNotNull(), T.BooleanType()
        if e.name in ("IF", "COALESCE"):
            parts = [self.typed(a) for a in (e.args[1:] if e.name == "IF" else e.args)]
            kinds = {type(k) for _, k in parts if not isinstance(k, T.NullType)}
            if len(kinds) > 1 and not all(issubclass(k, NUMERIC) for k in kinds):
                parts = [(text_of(p), T.StringType()) for p in parts]
            kind = next((k for _, k in parts if not isinstance(k, T.NullType)), T.NullType())
            if len(kinds) > 1 and kind is not None and not isinstance(kind, T.StringType):
                kind = T.DoubleType() if any(not issubclass(k, WHOLE) for k in kinds) else T.LongType()
                parts = [(p[0].cast(kind), kind) for p in parts]
            if e.name == "COALESCE":
                return F.coalesce(*(c for c, _ in parts)), kind
            cond = self.flag(e.args[0])
            return F.when(cond, parts[0][0]).when(~cond, parts[1][0]), kind
        if e.name == "SAMETERM":
            (a, ka), (b, kb) = map(self.typed, e.args)
            return (text_of((a, ka)) == text_of((b, kb)) if type(ka) is type(kb) else F.lit(False)), T.BooleanType()
        if e.name in ("LANG", "DATATYPE", "ISLITERAL", "ISIRI", "ISURI", "ISBLANK"):
            return self._of_term(e)
        if e.name == "LANGMATCHES":
            a, b = (F.lower(text_of(self.typed(x))) for x in e.args)
            return F.when(b == "*", F.length(a) > 0).otherwise((a == b) | F.startswith(a, F.concat(b, F.lit("-")))), T.BooleanType()
        if e.name == "STRDT":
            # the text read as of the datatype; of one without a type here it stays text
            of = e.args[1].term.value if isinstance(e.args[1], A.Const) and isinstance(e.args[1].term, Iri) else None
            return self.functions[of](self.typed(e.args[0])) if of in self.functions else (text_of(self.typed(e.args[0])), T.StringType())
        f = self.functions.get(e.name)
        if f is None:
            raise UnknownFunction(f"function {e.name} is not known")
        return f(*map(self.typed, e.args))

    def _of_term(self, e: A.Call) -> Typed:
        if not isinstance(e.args[0], A.Ref):
            raise UnknownFunction(f"{e.name} is supported for variables only")
        name = e.args[0].var.name
        value = self.column(name)
        literal = self.column(f"{name}@literal")
        if value is None:
            return F.lit(None).cast("string"), T.NullType()
        is_literal = literal[0] if literal else F.lit(not isinstance(value[1], T.StringType))
        present = value[0].isNotNull()
        if e.name == "LANG":
            lang = self.column(f"{name}@lang")
            return (lang[0] if lang else F.when(present, F.lit(""))), T.StringType()
        if e.name == "DATATYPE":
            dt = self.column(f"{name}@dt")
            of = {T.LongType: "integer", T.IntegerType: "int", T.DoubleType: "double", T.FloatType: "float", T.BooleanType: "boolean", T.TimestampType: "dateTime", T.StringType: "string"}
            return (dt[0] if dt else F.when(present, F.lit(self.name(XSD + of.get(type(value[1]), "string"))))), T.StringType()
        blank = F.startswith(value[0].cast("string"), F.lit("_:"))
        return F.when(present, {"ISLITERAL": is_literal, "ISBLANK": ~is_literal & blank}.get(e.name, ~is_literal & ~blank)), T.BooleanType()
