"""Series of a live service: slices on the executors, and aggregates that the service computes itself."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_engine import LATE, LEVEL, LEVELS, MIDNIGHT, START, TRIPLES, ask, plant_triples, same

from tidegraph.engine import Engine
from tidegraph.sources.series import HistorySource, SeriesError
from tidegraph.sources.service import ServiceReader, ServiceSource

CLIENT = """
from datetime import datetime, timedelta
LEVELS = {levels}
START = {start!r}


class Memory:
    def __init__(self, options):
        self.shift = int(options.get("shift", 0))

    def rows(self, ids, start, end):
        for i, vs in LEVELS.items():
            for k, v in enumerate(vs):
                t = START + timedelta(seconds=4 * k)
                if (ids is None or i in ids) and start <= t < end:
                    yield i, t, v

    read = rows

    def processed(self, ids, start, end, aggregate, seconds):
        found = dict()
        for i, t, v in self.rows(ids, start, end):
            found.setdefault((i, t - (t - datetime(1970, 1, 1)) % timedelta(seconds=seconds)), []).append(v)
        f = dict(SUM=sum, COUNT=len, MIN=min, MAX=max)[aggregate]
        for (i, t), vs in found.items():
            yield i, t, f(vs) + self.shift
"""
PERIOD = "BIND(xsd:integer(FLOOR(m:DateTimeAsSeconds(?t) / 8.0)) AS ?slot) "


def periods(f, rows, by=("x",)):
    found = {}
    for i, vs in LEVELS.items():
        for k, v in enumerate(vs):
            t = START + timedelta(seconds=4 * k)
            if rows(t):
                found.setdefault((i, int((t - datetime(1970, 1, 1)).total_seconds()) // 8), []).append(v)
    return [({"qa": "intake", "qb": "outlet"}[i], slot, f(vs)) for (i, slot), vs in found.items()]


@pytest.fixture(scope="module")
def client(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("client") / "plant_client.py"
    path.write_text(CLIENT.format(levels=LEVELS, start=START).replace("datetime.datetime(", "datetime("))
    spark.sparkContext.addPyFile(str(path))
    return "plant_client:Memory"


def engine_of(spark, source):
    return Engine(spark.createDataFrame(plant_triples(), TRIPLES)).set_time_series(source)


def test_slices_are_partitions():
    o = {"client": "x:y", "start": "2023-01-01T00:00:00", "end": "2023-01-02T06:00:00", "slice_s": "43200", "ids": '["a", "b", "c"]', "ids_per_slice": "2"}
    got = [(p.ids, p.start.hour, (p.end - p.start).total_seconds()) for p in ServiceReader(o).partitions()]
    assert got == [(["a", "b"], 0, 43200), (["c"], 0, 43200), (["a", "b"], 12, 43200), (["c"], 12, 43200), (["a", "b"], 0, 21600), (["c"], 0, 21600)]


def test_readings_of_a_service(spark, client):
    e = engine_of(spark, ServiceSource(spark, client, START - timedelta(seconds=40), START + timedelta(seconds=80), "bigint", slice_s=16, ids=["qa", "qb"]))
    q = f"SELECT ?x ?t ?v WHERE {{ {LEVEL} {LATE} }}"
    late = datetime.fromisoformat(MIDNIGHT)
    want = [({"qa": "intake", "qb": "outlet"}[i], t, v) for i, vs in LEVELS.items() for k, v in enumerate(vs) if (t := START + timedelta(seconds=4 * k)) >= late]
    assert same(ask(e, q), want)


@pytest.mark.parametrize("name, f", [("SUM", sum), ("COUNT", len), ("MIN", min), ("MAX", max)])
def test_aggregates_of_a_service(spark, client, name, f):
    """Where a period and its bounds fit, the service is asked for aggregates: its answers, shifted by 1000, come through."""
    e = engine_of(spark, ServiceSource(spark, client, START - timedelta(seconds=40), START + timedelta(seconds=80), "bigint", slice_s=24, options={"shift": "1000"}))
    q = f"SELECT ?x ?slot ({name}(?v) AS ?y) WHERE {{ {LEVEL} {PERIOD} %s }} GROUP BY ?x ?slot"
    assert same(ask(e, q % LATE), [(x, s, y + 1000) for x, s, y in periods(f, lambda t: t >= datetime.fromisoformat(MIDNIGHT))])
    # conditions on values, or bounds within a period, need the readings
    assert same(ask(e, q % "FILTER(?v > 0)"), periods(f, lambda t: True))
    odd = START + timedelta(seconds=6)
    assert same(ask(e, q % f'FILTER(?t >= "{odd.isoformat()}Z"^^xsd:dateTime)'), periods(f, lambda t: t >= odd))


def test_history_with_and_without_aggregates(spark):
    rows = spark.createDataFrame([(i, START + timedelta(seconds=4 * k), v) for i, vs in LEVELS.items() for k, v in enumerate(vs)], "id string, timestamp timestamp, value bigint")
    asked = []

    def processed(start, end, aggregate, seconds):
        asked.append((aggregate, seconds))
        at = F.timestamp_seconds(F.floor(F.unix_seconds("timestamp") / seconds) * seconds)
        return rows.groupBy("id", at.alias("timestamp")).agg(F.expr(f"{aggregate}(value)").alias("value"))

    q = f"SELECT ?slot (MAX(?v) AS ?y) WHERE {{ {LEVEL} BIND(60 * FLOOR(m:DateTimeAsSeconds(?t) / 60) AS ?slot) }} GROUP BY ?slot"
    plain, own = (ask(engine_of(spark, HistorySource(lambda start, end: rows, p)), q) for p in (None, processed))
    assert same(plain, own) and len(own) == 2 and ("MAX", 60) in asked
    asked.clear()
    ask(engine_of(spark, HistorySource(lambda start, end: rows, processed)), q.replace("MAX", "AVG"))
    assert not asked


def test_slices_must_hold_whole_intervals(spark, client):
    source = ServiceSource(spark, client, START, START + timedelta(seconds=80), "bigint", slice_s=20)
    assert source.scan_processed(None, [], "SUM", 8) is None
    with pytest.raises(SeriesError):
        source._load([], "bigint", aggregate="SUM", seconds=8)
