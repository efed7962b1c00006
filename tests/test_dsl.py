"""The path language: parsing, translation, and results."""

from datetime import UTC, datetime, timedelta

import pytest
from test_engine import LEVELS, PLANT, START, TRIPLES, plant_triples

from tidegraph.dsl.parser import Condition, Connective, Element, Path, PathError, Query, duration, parse_api, parse_query
from tidegraph.dsl.translate import ELEMENT, NAME, TranslationError, Translator
from tidegraph.engine import VOCABULARY, Engine
from tidegraph.sources.series import FrameSource
from tidegraph.sparql import algebra as A
from tidegraph.sparql.parser import parse
from tidegraph.sparql.printer import query_text
from tidegraph.terms import RDFS, XSD, Iri

TEXT = """
    Mill;[saw]"North"."Blade"/"rpm"
    [saw]."Motor"."temp" < 80.5
    from 2020-02-29T12:00:00-02:00
    to 2020-03-01
"""
PERIOD, SEMI, SLASH = Connective("."), Connective(";"), Connective("/")
RPM = Path((Element(type="Mill"), Element("saw", "North"), Element(name="Blade"), Element(name="rpm")), (SEMI, PERIOD, SLASH))
TEMP = Path((Element("saw"), Element(name="Motor"), Element(name="temp")), (PERIOD, PERIOD))


def test_parse():
    got = parse_query(TEXT + " group saw\n aggregate maximum 1h15m\n")
    assert got == Query((Condition(RPM), Condition(TEMP, "<", 80.5)), datetime(2020, 2, 29, 14, tzinfo=UTC), datetime(2020, 3, 1, tzinfo=UTC), ("saw",), "MAX", 4500 * 10**9)


@pytest.mark.parametrize("tail, op, value", [("= false", "=", False), ("!= -2.25", "!=", -2.25), ("<= 14", "<=", 14), (">12", ">", 12), ('LIKE "hot%"', "like", "hot%"), (">= [saw].\"rpm\"", ">=", Path((Element("saw"), Element(name="rpm")), (PERIOD,)))])
def test_conditions(tail, op, value):
    assert parse_query(f'[saw]."Motor"."temp" {tail}').conditions == (Condition(TEMP, op, value),)


def test_elements_and_durations():
    assert parse_query('[g]"n":Kind//"x"').conditions[0].path == Path((Element("g", "n", "Kind"), Element(name="x")), (Connective("/", 2),))
    assert [parse_query(f"Mill;Saw{end}").conditions[0].path.optional for end in ("", "?", " ?")] == [False, True, True]
    assert {x: duration(x) for x in ("90s", "250us", "2d12h", "1w")} == {"90s": 90 * 10**9, "250us": 250_000, "2d12h": 216_000 * 10**9, "1w": 604_800 * 10**9}
    for bad in (" ", ".Mill", "Mill;", "Mill <", "Mill near 3", "Mill\naggregate median 1h", "Mill\naggregate min 3 fortnights", "Mill\nto tomorrow", "Mill\ngroup a\nSaw", "Mill\nfrom 2020\nfrom 2021", "true.Saw"):
        with pytest.raises(PathError):
            parse_query(bad)


def test_api():
    api = parse_api('Mill;[saw]"North"."Blade"/"rpm" -> speed:Whole\n[saw]."Motor"."temp"? -> heat:Real\n[saw]."wear":Estimate <- wear:Real\ngroup saw\n')
    assert [(p.arrow, p.label, p.type, p.path.optional) for p in api.ports] == [("->", "speed", "Whole", False), ("->", "heat", "Real", True), ("<-", "wear", "Real", False)]
    assert api.ports[0].path == RPM and api.group == ("saw",)
    for bad in ("group saw", '[saw]."temp" -> heat:Real', '[saw]."temp" => heat:Real\ngroup saw'):
        with pytest.raises(PathError):
            parse_api(bad)


def test_translation_names_and_text():
    t = Translator(VOCABULARY, PLANT + "named", {";": "urn:semi", ".": "urn:period", "/": "urn:slash"})
    names = [v.name for v in t.translate(parse_query(TEXT)).names]
    # a name: what leads to the element from the last glue, with the connective before the one that leads there
    rpm, temp = "saw__Semicolon___Blade___Period___rpm_", "saw_Motor___Period___temp_"
    assert names == [f"{n}_{end}" for end in ("path_name", "timeseries_datapoint_value") for n in (rpm, temp)] + ["timestamp"]
    for tail in ("", "aggregate min 250ms", "group saw", "group saw\naggregate count 1d"):
        node = t.translate(parse_query(TEXT + tail))
        again = parse(query_text(node), frozenset({VOCABULARY + "nestAggregation"}))
        assert A.variables(again) == A.variables(node)
    for bad in ("Mill-Saw", "Mill?", "Mill;[saw]\ngroup axe"):
        with pytest.raises(TranslationError):
            t.translate(parse_query(bad))


@pytest.fixture(scope="module")
def engine(spark):
    text = lambda s, o: (s, RDFS + "label", o, "literal", XSD + "string", None)
    rows = plant_triples()
    for pump, kind, k in ("intake", "Intake", "a"), ("outlet", "Outlet", "b"):
        p, g = PLANT + pump, PLANT + "g" + k
        rows += [text(p, pump), text(g, "Level"), text(PLANT + kind, kind), (p, PLANT + "has", g, "iri", None, None), (p, PLANT + "code", k.upper(), "literal", XSD + "string", None), (g, PLANT + "code", "L", "literal", XSD + "string", None)]
    readings = [(i, START + timedelta(seconds=4 * k), v) for i, vs in LEVELS.items() for k, v in enumerate(vs)]
    e = Engine(spark.createDataFrame(rows, TRIPLES)).set_time_series(FrameSource(spark.createDataFrame(readings, "id string, timestamp timestamp, value bigint")))
    return e.name_predicate(RDFS + "label").connective_mapping({"/": PLANT + "has"})


def test_means_of_periods(engine):
    df = engine.execute_dsl_query('Outlet/"Level"\nfrom 2023-03-05T23:59:44+00:00\nto 2023-03-06T00:00:12Z\naggregate avg 20s\n')
    assert df.columns == ["Outlet_Level__path_name", "Outlet_Level__timeseries_datapoint_value", "timestamp"]
    vs = LEVELS["qb"]
    want = [("outlet/Level", sum(vs[1:5]) / 4, START), ("outlet/Level", sum(vs[5:9]) / 4, START + timedelta(seconds=20))]
    assert sorted(map(tuple, df.collect()), key=str) == want


def test_conditions_groups_and_optional(engine):
    rows = engine.execute_dsl_query('[p]Outlet/"Level" > 60\n').collect()
    assert sorted(r["p_Level__timeseries_datapoint_value"] for r in rows) == [66, 70, 91]
    rows = engine.execute_dsl_query('[p]/"Level"\ngroup p\naggregate max 40s').collect()
    tops = {}
    for i, pump in ("qa", "intake"), ("qb", "outlet"):
        for k, v in enumerate(LEVELS[i]):
            at = pump, int((START + timedelta(seconds=4 * k) - datetime(1970, 1, 1)).total_seconds()) // 40
            tops[at] = max(v, tops.get(at, 0))
    assert sorted((r["p_path_name"], r["p_Level__timeseries_datapoint_value"]) for r in rows) == sorted((pump, [v]) for (pump, _), v in tops.items())
    rows = engine.execute_dsl_query('[p]Intake/"Level"\n[p]/"Colour"?\n').collect()
    assert sorted(r["p_Level__timeseries_datapoint_value"] for r in rows) == sorted(LEVELS["qa"]) and all(r["p_Colour__timeseries_datapoint_value"] is None for r in rows)


def test_two_paths_share_the_time(engine):
    rows = engine.execute_dsl_query('[p]Intake/"Level"\n[q]Outlet/"Level" != [p]/"Level"\n').collect()
    both = [(a, b) for a, b in zip(LEVELS["qa"], LEVELS["qb"]) if a != b]
    assert sorted((r["p_Level__timeseries_datapoint_value"], r["q_Level__timeseries_datapoint_value"]) for r in rows) == sorted(both)


def test_own_templates(engine):
    e = Engine(engine.store).set_time_series(engine.series).connective_mapping({"/": PLANT + "has"})
    e.templates([(ELEMENT, Iri(PLANT + "code"), NAME)])
    rows = e.execute_dsl_query('"B"/"L" = 91').collect()
    assert [(r["B_L__path_name"], r["B_L__timeseries_datapoint_value"]) for r in rows] == [("B/L", 91)]
