"""Sources of time series, each a DataFrame (id, timestamp, value)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.session import col

#: Bounds of a timestamp: a comparison and a time in UTC.
Bound = tuple[str, datetime]


class SeriesError(ValueError):
    """A series source cannot answer."""


class InconsistentDatatype(SeriesError):
    """The series bound to one variable are of several datatypes."""


class SeriesSource(Protocol):
    def scan(self, datatype: str | None, bounds: Sequence[Bound] = ()) -> DataFrame:
        """(id, timestamp, value) of the series of a datatype; of all if there is but one table. bounds may be used to read less.

        A source may also have ``scan_processed(datatype, bounds, aggregate, seconds)``, which gives aggregates over intervals, or None.
        """


@dataclass
class FrameSource:
    """Series held in one DataFrame of any datatype."""

    frame: DataFrame
    id: str = "id"
    timestamp: str = "timestamp"
    value: str = "value"

    def scan(self, datatype: str | None, bounds: Sequence[Bound] = ()) -> DataFrame:
        return self.frame.select(col(self.id).alias("id"), col(self.timestamp).alias("timestamp"), col(self.value).alias("value"))


class MemorySource:
    """Series given one by one: a DataFrame (timestamp, value) for each id."""

    def __init__(self, frames: dict[str, DataFrame]) -> None:
        if not frames:
            raise SeriesError("there are no series")
        self.frames = frames

    def scan(self, datatype: str | None, bounds: Sequence[Bound] = ()) -> DataFrame:
        return reduce(DataFrame.unionByName, (f.select(F.lit(i).alias("id"), "timestamp", "value") for i, f in self.frames.items()))


@dataclass
class TimeSeriesTable:
    """A table of series of one datatype: a DataFrame, or a path with its format, and the names of its columns.

    year, month and day name the columns by which the table is partitioned, all three or none; bounds on the timestamp are then
    also put as bounds on them, so that only the partitions in question are read.
    """

    value_datatype: str
    frame: DataFrame | None = None
    path: str | None = None
    format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)
    identifier_column: str = "id"
    timestamp_column: str = "timestamp"
    value_column: str = "value"
    year_column: str | None = None
    month_column: str | None = None
    day_column: str | None = None

    def __post_init__(self) -> None:
        parts = (self.year_column, self.month_column, self.day_column)
        if any(parts) and not all(parts):
            raise SeriesError("year, month and day columns must be given together")

    def load(self, spark: SparkSession) -> DataFrame:
        if self.frame is not None:
            return self.frame
        return spark.read.format(self.format).options(**self.options).load(self.path)

    def partition_condition(self, bounds: Sequence[Bound]) -> Column | None:
        """What the bounds say of the partition columns: no row within the bounds is lost."""
        if not self.year_column:
            return None
        y, m, d = (col(c).cast("int") for c in (self.year_column, self.month_column, self.day_column))
        cond = None
        for op, at in bounds:
            ay, am, ad = F.lit(at.year), F.lit(at.month), F.lit(at.day)
            if op == "=":
                one = (y == ay) & (m == am) & (d == ad)
            elif op in (">", ">="):
                one = (y > ay) | ((y == ay) & ((m > am) | ((m == am) & (d >= ad))))
            elif op in ("<", "<="):
                one = (y < ay) | ((y == ay) & ((m < am) | ((m == am) & (d <= ad))))
            else:
                continue
            cond = one if cond is None else cond & one
        return cond


class TableSource:
    """Several tables, one for each datatype; without a datatype all of them, their values brought to one type."""

    def __init__(self, spark: SparkSession, tables: Sequence[TimeSeriesTable]) -> None:
        if not tables:
            raise SeriesError("there are no tables")
        self.spark, self.tables = spark, list(tables)

    def scan(self, datatype: str | None, bounds: Sequence[Bound] = ()) -> DataFrame:
        if datatype is None:
            frames = [self._read(t, bounds) for t in self.tables]
            types = [f.schema["value"].dataType for f in frames]
            kind = types[0] if len(set(types)) == 1 else T.DoubleType() if all(isinstance(t, T.NumericType) for t in types) else T.StringType()
            return reduce(DataFrame.unionByName, (f.withColumn("value", F.col("value").cast(kind)) for f in frames))
        local = lambda d: d.rpartition("#")[2].removeprefix("xsd:")
        fit = next((t for t in self.tables if local(t.value_datatype) == local(datatype)), None)
        if fit is None:
            raise SeriesError(f"no table holds series of datatype {datatype}")
        return self._read(fit, bounds)

    def _read(self, t: TimeSeriesTable, bounds: Sequence[Bound]) -> DataFrame:
        rows = t.load(self.spark)
        cond = t.partition_condition(bounds)
        if cond is not None:
            rows = rows.where(cond)
        return rows.select(col(t.identifier_column).alias("id"), col(t.timestamp_column).alias("timestamp"), col(t.value_column).alias("value"))


def span_of(bounds: Sequence[Bound]) -> tuple[datetime | None, datetime | None]:
    """The span from a start, inclusive, to an end, exclusive, that holds all times within the bounds; None where there is no bound."""
    start = max((at for op, at in bounds if op in (">", ">=", "=")), default=None)
    end = min((at if op == "<" else at + timedelta(microseconds=1) for op, at in bounds if op in ("<", "<=", "=")), default=None)
    return start, end


@dataclass
class HistorySource:
    """A history service: ``read`` gives (id, timestamp, value) from a start (inclusive) to an end (exclusive), either may be None.

    Strict bounds are kept as they are: the rows outside are filtered by the query. ``processed``, if given, is asked for aggregates over
    intervals: (start, end, aggregate, seconds) to a frame (id, start of interval, aggregate), with AVG, SUM, COUNT, MIN or MAX.
    """

    read: Callable[[datetime | None, datetime | None], DataFrame]
    processed: Callable[[datetime | None, datetime | None, str, int], DataFrame] | None = None

    def scan(self, datatype: str | None, bounds: Sequence[Bound] = ()) -> DataFrame:
        return self.read(*span_of(bounds)).select("id", "timestamp", "value")

    def scan_processed(self, datatype: str | None, bounds: Sequence[Bound], aggregate: str, seconds: int) -> DataFrame | None:
        return self.processed(*span_of(bounds), aggregate, seconds).select("id", "timestamp", "value") if self.processed else None
