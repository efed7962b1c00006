"""Templates: parsing, typing, expansion, minting, resolving, N-Triples."""

import contextlib
import importlib.util
from datetime import datetime

import pytest

from tidegraph.engine import Engine
from tidegraph.stottr.mapping import ColumnTypeMismatch, IrrelevantColumn, KeyColumnError, Mapping, MintingOptions, MissingColumn, NonBlankViolated, NonOptionalNull, PTypeNotSupported, ResolveIRI, ResolvingError, ntriples
from tidegraph.stottr import mapping as M
from tidegraph.stottr.parser import TemplateError, TemplateNotFound, Templates, Type, TypesDisagree, UnknownPrefix, parse_document
from tidegraph.sparql.algebra import Triple
from tidegraph.terms import RDF, XSD, Blank, Iri, Literal

EX = "http://example.net/ns#"
HEAD = f"@prefix ex:<{EX}>.\n"


def run(spark, text, rows, schema, **options):
    m = Mapping(HEAD + text, spark)
    m.expand("ex:T", spark.createDataFrame(rows, schema), **options)
    return short(m.triples())


def short(df):
    cut = lambda x: x and x.replace(EX, "").replace(XSD, "").replace(RDF, "")
    return sorted(tuple(cut(x) for x in (r.s, r.p, r.o, r.o_dt, r.o_lang) if x) for r in df.collect())


def test_two_numbers(spark):
    got = run(spark, "ex:T [?a , ?b] :: { ottr:Triple(ex:x, ex:p, ?a) , ottr:Triple(ex:x, ex:q, ?b) } .", [("1", 1, 3), ("2", 2, 4)], "Key string, a int, b int")
    assert got == [("x", "p", "1", "int"), ("x", "p", "2", "int"), ("x", "q", "3", "int"), ("x", "q", "4", "int")]


def test_iris_and_blank_nodes(spark):
    got = run(spark, "ex:T [xsd:anyURI ?a, ?b, xsd:anyURI ?c] :: { ottr:Triple(?a, ?b, ?c) } .", [("1", EX + "s", EX + "p", "_:n")], "Key string, a string, b string, c string")
    assert got == [("s", "p", "_:n")]


def test_language_tags(spark):
    got = run(spark, 'ex:T [?a] :: { ottr:Triple(ex:x, ex:p, ?a) , ottr:Triple(ex:y, ex:p, "hi"@ar-SA) } .', [("1", "one"), ("2", "two")], "Key string, a string", language_tags={"a": "bn-BD"})
    assert sorted(set(got)) == [("x", "p", "one", "langString", "bn-BD"), ("x", "p", "two", "langString", "bn-BD"), ("y", "p", "hi", "langString", "ar-SA")]


def test_expanders(spark):
    assert run(spark, "ex:T [xsd:anyURI ?a] :: { cross | ottr:Triple(?a, ex:p, ++(1,2)) } .", [("1", EX + "s")], "Key string, a string") == [("s", "p", "1", "integer"), ("s", "p", "2", "integer")]
    schema = "Key string, s string, a array<int>, b array<int>"
    two = "ex:T [?s, ?a, ?b] :: { %s | ex:N(?s, ++?a, ++?b) } . ex:N [xsd:anyURI ?s, ?x, ?y] :: { ottr:Triple(?s, ex:x, ?x), ottr:Triple(?s, ex:y, ?y) } ."
    rows = [("1", EX + "s", [1, None], [3, 4, 5])]
    count = lambda kind: [len([t for t in run(spark, two % kind, rows, schema) if t[1] == p]) for p in "xy"]
    assert count("cross") == [3, 6] and count("zipMin") == [1, 2] and count("zipMax") == [1, 3]


def test_nested_defaults_and_ground_instances(spark):
    text = 'ex:T [?a, ?b = "none given"] :: { ex:N(?a), ottr:Triple(ex:x, ex:q, ?b) } . ex:N [?v] :: { ottr:Triple(ex:x, ex:p, ?v) } . ex:N(7) .'
    got = run(spark, text, [("1", 1)], "Key string, a int")
    assert got == [("x", "p", "1", "int"), ("x", "p", "7", "integer"), ("x", "q", "none given", "string")]


def test_mint_and_resolve(spark):
    m = Mapping(HEAD + "ex:T [xsd:anyURI ?a, xsd:anyURI ?b] :: { ottr:Triple(?a, ex:p, ?b) } . ex:U [xsd:anyURI ?a, xsd:anyURI ?b] :: { ottr:Triple(?a, ex:q, ?b) } . ex:L [xsd:anyURI ?a, NEList<xsd:anyURI> ?b] :: { cross | ottr:Triple(?a, ex:r, ++?b) } .", spark)
    m.expand("ex:T", spark.createDataFrame([("k2", EX + "two"), ("k1", EX + "one")], "Key string, a string"), mint_iris={"b": MintingOptions(EX + "n", 3)})
    assert short(m.triples()) == [("one", "p", "n3"), ("two", "p", "n4")]
    m.expand("ex:U", spark.createDataFrame([("x", EX + "x", "k2"), ("y", EX + "y", "k9")], "Key string, a string, f string"), resolve_iris={"b": ResolveIRI("f", "ex:T", "b")}, validate=False)
    m.expand("ex:L", spark.createDataFrame([("z", EX + "z", ["k2", "k1"])], "Key string, a string, f array<string>"), resolve_iris={"b": ResolveIRI("f", "ex:T", "b")})
    assert short(m.triples())[1:] == [("two", "p", "n4"), ("x", "q", "n4"), ("z", "r", "n3"), ("z", "r", "n4")]
    with pytest.raises(ResolvingError):
        m.expand("ex:U", spark.createDataFrame([("x", EX + "x", "k2")], "Key string, a string, f string"), resolve_iris={"b": ResolveIRI("f", "ex:U", "b")})


def test_mint_lists(spark):
    m = Mapping(HEAD + "ex:T [?v, NEList<xsd:anyURI> ?b] :: { zipMax | ottr:Triple(++?b, ex:p, ++?v) } .", spark)
    m.expand("ex:T", spark.createDataFrame([("1", [7, 8]), ("2", [9])], "Key string, v array<int>"), mint_iris={"b": MintingOptions(EX + "n", 1, same_length_as="v")})
    assert short(m.triples()) == [("n1", "p", "7", "int"), ("n2", "p", "8", "int"), ("n3", "p", "9", "int")]


def test_resolve_nested_lists(spark):
    m = Mapping(HEAD + """ex:T [xsd:anyURI ?a, xsd:anyURI ?b] :: { ottr:Triple(?a, ex:p, ?b) } .
    ex:L [xsd:anyURI ?a, List<List<xsd:anyURI>> ?b] :: { cross | ex:M(?a, ++?b) } . ex:M [xsd:anyURI ?a, List<xsd:anyURI> ?b] :: { cross | ottr:Triple(?a, ex:r, ++?b) } .""", spark)
    m.expand("ex:T", spark.createDataFrame([(k, EX + k) for k in "abc"], "Key string, a string"), mint_iris={"b": MintingOptions(EX + "n", 0)})
    rows = [("x", EX + "x", [["c", "a"], [], ["none", "b"]]), ("y", EX + "y", [["a", "a"], None]), ("z", EX + "z", [])]
    lists = m._resolve(spark.createDataFrame(rows, "Key string, a string, f array<array<string>>"), "b", ResolveIRI("f", "ex:T", "b"))
    n = lambda i: EX + f"n{i}"
    assert {r.Key: r.b for r in lists.collect()} == {"x": [[n(2), n(0)], [], [None, n(1)]], "y": [[n(0), n(0)], None], "z": None}
    m.expand("ex:L", spark.createDataFrame(rows, "Key string, a string, f array<array<string>>"), resolve_iris={"b": ResolveIRI("f", "ex:T", "b")}, validate=False)
    assert [t for t in short(m.triples()) if t[1] == "r"] == [("x", "r", "n0"), ("x", "r", "n1"), ("x", "r", "n2"), ("y", "r", "n0"), ("y", "r", "n0")]


def test_mint_lists_over_partitions(spark):
    """Lists of any length, some empty or null, numbered in order of their keys over many partitions."""
    rows = [(f"{k:04}", None if k % 11 == 0 else [k] * (k % 4)) for k in range(400)]
    m = Mapping(HEAD + "ex:T [?v, List<xsd:anyURI> ?b] :: { zipMax | ex:N(++?b, ++?v) } . ex:N [xsd:anyURI ?n, ? xsd:int ?v] :: { ottr:Triple(?n, ex:p, ?v) } .", spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        m.expand("ex:T", spark.createDataFrame(rows, "Key string, v array<int>").repartition(7), mint_iris={"b": MintingOptions(EX + "n", 2, same_length_as="v")}, validate=False)
        got = {int(r.s.removeprefix(EX + "n")): int(r.o) for r in m.triples().collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == dict(enumerate([x for _, v in rows for x in v or []], 2))


def test_triples_as_objects(spark):
    m = Mapping(HEAD + 'ex:T [xsd:anyURI ?a, ?b] :: { ottr:Triple(?a, ex:p, ?b), ottr:Triple(_:n, ex:q, ?a), ottr:Triple(?a, ex:r, "hei"@nb) } .', spark)
    m.expand("ex:T", spark.createDataFrame([("1", EX + "s", 5)], "Key string, a string, b int"))
    s, p = Iri(EX + "s"), lambda x: Iri(EX + x)
    want = [Triple(s, p("p"), Literal("5", XSD + "int")), Triple(s, p("r"), Literal("hei", RDF + "langString", "nb"))]
    got = list(m.objects())
    assert [t for t in got if t.s == s] == want and [(type(t.s), t.o) for t in got if t.p == p("q")] == [(Blank, s)]
    with pytest.raises(ImportError) if not importlib.util.find_spec("rdflib") else contextlib.nullcontext():
        assert len(m.to_graph()) == 3


def test_datatypes(spark):
    names = "abcdefghi"
    text = f"ex:T [{', '.join('?' + n for n in names)}] :: {{ {', '.join(f'ottr:Triple(ex:x, ex:{n}, ?{n})' for n in names)} }} ."
    at = datetime(2022, 8, 17, 10, 42, 1, 250_000)
    from decimal import Decimal

    got = run(spark, text, [("1", True, 1, 2, 3.5, 4.5, "t", at, at.replace(microsecond=0), Decimal(2**64 - 1))], "Key string, a boolean, b int, c bigint, d float, e double, f string, g timestamp, h timestamp, i decimal(20,0)", time_zones={"g": "Europe/Oslo"})
    assert {t[1]: t[2:] for t in got} == {
        "a": ("true", "boolean"), "b": ("1", "int"), "c": ("2", "long"), "d": ("3.5", "float"), "e": ("4.5", "double"), "f": ("t", "string"),
        "g": ("2022-08-17T12:42:01.250+02:00", "dateTimeStamp"), "h": ("2022-08-17T10:42:01", "dateTime"), "i": ("18446744073709551615", "unsignedLong"),
    }


def test_inferred_types():
    t = Templates([parse_document(HEAD + "ex:T [?a, ?l] :: { ex:N(?a, ?l) } . ex:N [?s, ?l] :: { cross | ottr:Triple(?s, ex:p, ++?l), cross | ottr:Triple(ex:x, ++?l, ?s) } .")])
    assert [p.type for p in t.find("ex:T").parameters] == [Type(XSD + "anyURI"), Type("NEList", Type(XSD + "anyURI"))]


ONE = "ex:T [xsd:anyURI ?a] :: { ottr:Triple(?a, ex:p, 1) } ."


@pytest.mark.parametrize(
    "text, rows, schema, error",
    [
        (ONE, [("1", "x"), ("1", "y")], "Key string, a string", KeyColumnError), (ONE, [("1",)], "Key string", MissingColumn), (ONE, [("1", "x", 1)], "Key string, a string, z int", IrrelevantColumn),
        (ONE, [("1", 3)], "Key string, a int", ColumnTypeMismatch), (ONE, [("1", None)], "Key string, a string", NonOptionalNull), (ONE.replace("xsd", "! xsd"), [("1", "_:b")], "Key string, a string", NonBlankViolated),
        (ONE.replace("xsd:anyURI ", "xsd:int ").replace("?a, ex:p, 1", "ex:x, ex:p, ?a"), [("1", "t")], "Key string, a string", ColumnTypeMismatch),
        ("ex:T [?a] :: { ottr:Triple(ex:x, ex:p, ?a) } .", [("1", datetime(2022, 1, 1).date())], "Key string, a date", PTypeNotSupported),
    ],
)
def test_errors(spark, text, rows, schema, error):
    with pytest.raises(error):
        run(spark, text, rows, schema)


@pytest.mark.parametrize(
    "options, rows, schema, error",
    [
        ({}, [(1, "x")], "Key int, a string", M.InvalidKeyColumnType), ({}, [("x",)], "a string", M.MissingKeyColumn), ({}, [("1", "x"), ("1", "y")], "Key string, a string", M.DuplicateKeys),
        ({"resolve_iris": {"a": ResolveIRI("f", "ex:T", "a")}}, [("1",)], "Key string", M.MissingForeignKeyColumn), ({"resolve_iris": {"a": ResolveIRI("f", "ex:T", "a")}}, [("1", "k")], "Key string, f string", M.NothingMintedForTemplate),
        ({"time_zones": {"a": "Mars/Base"}}, [("1", "x")], "Key string, a string", M.UnknownTimeZone), ({}, [("1", {"k": 1})], "Key string, a map<string,int>", PTypeNotSupported),
    ],
)
def test_kinds_of_errors(spark, options, rows, schema, error):
    text = ONE if "map" not in schema else "ex:T [?a] :: { ottr:Triple(ex:x, ex:p, ?a) } ."
    with pytest.raises(error):
        run(spark, text, rows, schema, **options)


def test_errors_of_minting_and_lists(spark):
    m = Mapping(HEAD + "ex:T [xsd:anyURI ?a, xsd:anyURI ?b] :: { ottr:Triple(?a, ex:p, ?b) } .", spark)
    rows = lambda *keys: spark.createDataFrame([(k, EX + k) for k in keys], "Key string, a string")
    m.expand("ex:T", rows("k1", "k2"), mint_iris={"b": MintingOptions(EX + "n")})
    with pytest.raises(M.MintedBefore):
        m.expand("ex:T", rows("k2", "k3"), mint_iris={"b": MintingOptions(EX + "m")})
    m.expand("ex:T", rows("k3"), mint_iris={"b": MintingOptions(EX + "m")})
    with pytest.raises(M.NothingMintedForArgument):
        m.expand("ex:T", spark.createDataFrame([("k4", "k1", EX + "x")], "Key string, f string, b string"), resolve_iris={"a": ResolveIRI("f", "ex:T", "a")})
    with pytest.raises((M.UnlikeTerms, TemplateError)):
        run(spark, 'ex:T [xsd:anyURI ?a] :: { cross | ottr:Triple(?a, ex:p, ++(1, "x")) } .', [("1", EX + "s")], "Key string, a string")
    for text, error in (("ex:T [?a] :: { ex:No(?a) } .", TemplateNotFound), ("ex:T [?a] :: { foo:T(?a) } .", UnknownPrefix), ("ex:T [xsd:int ?a] :: { ottr:Triple(?a, ex:p, 1) } .", TypesDisagree)):
        with pytest.raises(error):
            Templates([parse_document(HEAD + text)])


@pytest.mark.parametrize("text", ["ex:T [?a] :: { ex:No(?a) } .", "ex:T [?a] :: { ottr:Triple(?a) } .", "ex:T [?a] :: { ex:T(?a) } .", "ex:T [?a, ?a] .", "ex:T [?a] :: { foo:T(?a) } .", "@prefix ex:<http://other#> .", "ex:T [xsd:int ?a] :: { ottr:Triple(?a, ex:p, 1) } ."])
def test_bad_documents(text):
    with pytest.raises(TemplateError):
        Templates([parse_document(HEAD + text)])


def test_grammar():
    d = parse_document(HEAD + "ex:S [ ! ? ex:Type ?a = \"x\"@en, List<NEList<LUB<xsd:string>>> ?b ] @@ ex:Note(\"n\") . ex:B [?x] :: BASE . cross | ex:B(++(1, 2.5, 1e3)) . ex:B([]) . ex:B(none) .")
    s = d.templates[0]
    assert (s.parameters[0].optional, s.parameters[0].non_blank, s.parameters[0].default.lang, str(s.parameters[1].type)) == (True, True, "en", f"List<NEList<LUB<{XSD}string>>>")
    assert s.signature_only and d.templates[1].base and len(s.annotations) == 1 and len(d.instances) == 3


def test_ntriples_and_query(spark, tmp_path):
    m = Mapping(HEAD + "ex:T [xsd:anyURI ?a, ?b] :: { ottr:Triple(?a, ex:p, ?b) } .", spark)
    m.expand("ex:T", spark.createDataFrame([("1", EX + "s", 'a "b"\\\n')], "Key string, a string, b string"))
    assert [r.value for r in ntriples(m.triples()).collect()] == [f'<{EX}s> <{EX}p> "a \\"b\\"\\\\\\n" .']
    m.write_ntriples(str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1
    assert Engine(m.triples()).execute_hybrid_query(f"SELECT ?o WHERE {{ <{EX}s> <{EX}p> ?o }}").first()[0].startswith("a ")
