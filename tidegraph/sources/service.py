"""Series held by a live service, read by slices of time on the executors through Spark's interface of data sources."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from importlib import import_module
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidegraph.session import ship
from tidegraph.sources.series import Bound, SeriesError, span_of

NAME = "tidegraph_series"


class Client(Protocol):
    """What speaks a service's protocol. It is made anew in each task, from the options of the source."""

    def read(self, ids: Sequence[str] | None, start: datetime, end: datetime) -> Iterator[tuple[str, datetime, object]]:
        """(id, time, value) of the readings from start, inclusive, to end, exclusive; of all series if ids is None."""

    def processed(self, ids: Sequence[str] | None, start: datetime, end: datetime, aggregate: str, seconds: int) -> Iterator[tuple[str, datetime, object]]:
        """(id, start of interval, aggregate) of the intervals with readings; AVG, SUM, COUNT, MIN or MAX; start and end lie on intervals."""


class Slice(InputPartition):
    def __init__(self, ids: list[str] | None, start: datetime, end: datetime) -> None:
        self.ids, self.start, self.end = ids, start, end


class ServiceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[Slice]:
        o = self.options
        start, end, step = datetime.fromisoformat(o["start"]), datetime.fromisoformat(o["end"]), timedelta(seconds=int(o.get("slice_s", 86_400)))
        ids = json.loads(o["ids"]) if "ids" in o else None
        size = int(o.get("ids_per_slice", 100))
        groups = [None] if ids is None else [ids[i : i + size] for i in range(0, len(ids), size)]
        slices = []
        while start < end:
            slices += [Slice(g, start, min(start + step, end)) for g in groups]
            start += step
        return slices

    def read(self, partition: Slice) -> Iterator[tuple[str, datetime, object]]:
        o = self.options
        module, _, name = o["client"].partition(":")
        client = getattr(import_module(module), name)(dict(o))
        if "aggregate" in o:
            yield from client.processed(partition.ids, partition.start, partition.end, o["aggregate"], int(o["seconds"]))
        else:
            yield from client.read(partition.ids, partition.start, partition.end)


class SeriesService(DataSource):
    """The format ``tidegraph_series``; options: client (module:callable), start and end (ISO, UTC), value (SQL type), and optionally slice_s, ids (JSON), ids_per_slice, aggregate, seconds."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return f"id string, timestamp timestamp, value {self.options.get('value', 'double')}"

    def reader(self, schema: object) -> ServiceReader:
        return ServiceReader({k: str(v) for k, v in self.options.items()})


@dataclass
class ServiceSource:
    """A series source over a ``Client``: a slice of ``slice_s`` seconds, and of some series, is one task.

    client: "module:callable", importable on the executors; start and end: all times that the service may be asked for. Bounds of a
    query narrow them. Aggregates over intervals are handed to the service where ``processed`` is set (see ``Compiler``).
    """

    spark: SparkSession
    client: str
    start: datetime
    end: datetime
    value: str = "double"
    slice_s: int = 86_400
    ids: Sequence[str] | None = None
    options: dict[str, str] = field(default_factory=dict)
    processed: bool = True

    def _load(self, bounds: Sequence[Bound], value: str, **more: object) -> DataFrame:
        ship(self.spark)
        self.spark.dataSource.register(SeriesService)
        start, end = span_of(bounds)
        step = int(more.get("seconds", 1))
        if self.slice_s % step:
            raise SeriesError(f"slices of {self.slice_s} s hold no whole number of intervals of {step} s")
        first, last = max(start or self.start, self.start), min(end or self.end, self.end)
        if step > 1:  # whole intervals, and slices that begin on one
            epoch = datetime(1970, 1, 1)
            first -= (first - epoch) % timedelta(seconds=step)
        options = dict(self.options) | {"client": self.client, "start": first.isoformat(), "end": last.isoformat(), "value": value, "slice_s": str(self.slice_s)} | {k: str(v) for k, v in more.items()}
        if self.ids is not None:
            options["ids"] = json.dumps(list(self.ids))
        return self.spark.read.format(NAME).options(**options).load()

    def scan(self, datatype: str | None, bounds: Sequence[Bound] = ()) -> DataFrame:
        return self._load(bounds, self.value)

    def scan_processed(self, datatype: str | None, bounds: Sequence[Bound], aggregate: str, seconds: int) -> DataFrame | None:
        if not self.processed or self.slice_s % seconds:
            return None
        return self._load(bounds, "bigint" if aggregate == "COUNT" else "double" if aggregate == "AVG" else self.value, aggregate=aggregate, seconds=seconds)
