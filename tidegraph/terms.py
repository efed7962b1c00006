"""RDF terms and the Spark types of their datatypes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
WELL_KNOWN = {"rdf": RDF, "rdfs": RDFS, "xsd": XSD}
LANG_STRING = RDF + "langString"

#: Spark's type of each datatype; a decimal counts as a double.
SPARK_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(), "boolean": T.BooleanType(),
    "unsignedInt": T.LongType(), "unsignedLong": T.DecimalType(20, 0), "integer": T.LongType(), "long": T.LongType(), "int": T.IntegerType(), "short": T.ShortType(), "byte": T.ByteType(),
    "double": T.DoubleType(), "decimal": T.DoubleType(), "float": T.FloatType(),
    "dateTime": T.TimestampType(), "dateTimeStamp": T.TimestampType(), "date": T.DateType(), "anyURI": T.StringType(),
}


class UnsupportedDatatype(ValueError):
    """A literal's datatype has no Spark type."""


@dataclass(frozen=True)
class Iri:
    value: str

    def __str__(self) -> str:
        return f"<{self.value}>"


@dataclass(frozen=True)
class Blank:
    label: str

    def __str__(self) -> str:
        return f"_:{self.label}"


@dataclass(frozen=True)
class Literal:
    lexical: str
    datatype: str = XSD + "string"
    lang: str | None = None

    def __str__(self) -> str:
        text = '"' + escape(self.lexical) + '"'
        return f"{text}@{self.lang}" if self.lang else text if self.datatype == XSD + "string" else f"{text}^^<{self.datatype}>"


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return f"?{self.name}"


Term = Iri | Blank | Literal | Var


def escape(text: str) -> str:
    """A literal's text as it stands between quotes in N-Triples and queries."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(a, b)
    return text


def spark_type(datatype: str | None) -> T.DataType | None:
    """Spark's type of an xsd datatype, given in full or with the prefix xsd; None of an unknown one."""
    if datatype is None:
        return T.StringType()
    local = datatype.removeprefix(XSD).removeprefix("xsd:")
    return SPARK_TYPES.get(local) if local != datatype else T.StringType() if datatype in (LANG_STRING, "rdf:langString") else None


def literal_column(term: Literal) -> Column:
    """A constant of the literal's Spark type."""
    kind = spark_type(term.datatype)
    if kind is None:
        raise UnsupportedDatatype(f"datatype {term.datatype} is not supported")
    if isinstance(kind, T.BooleanType):
        return F.lit(term.lexical in ("true", "1"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.lit(float(term.lexical.replace("INF", "inf"))).cast(kind)
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return F.lit(int(term.lexical)).cast(kind)
    return F.lit(term.lexical).cast(kind)
