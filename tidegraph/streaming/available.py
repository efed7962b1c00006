"""Queries over a stream of readings: the engine compiles them as it does over tables, the graph stays static."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidegraph.session import Spool


def _exactly(path: str) -> str:
    """A pattern that fits this path alone; a source of files takes a single file by a pattern only."""
    head, _, name = path.rstrip("/").rpartition("/")
    safe = "".join("\\" + c if c in "\\*?[]{}" else c for c in name)
    return f"{head}/{safe[:-1]}[{safe[-1]}]" if name and name[-1] not in "\\*?[]{}^!-" else path


def readings_stream(spark: SparkSession, path: str, schema: T.StructType, watermark: tuple[str, str] | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of a parquet file, or of the parquet files in a folder; watermark is a column of time and how late its rows may come."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(_exactly(path))
    return rows.withWatermark(*watermark) if watermark else rows


def run_available(result: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a streaming query over what is there and gives its result as a table in the shared folder.

    complete: the result table after the last batch; append: all rows that batches gave. Each batch is written under its number,
    so a batch that is repeated after a failure replaces what it wrote before.
    """
    spool = Spool(result.sparkSession)
    out = f"{spool.root}/batches"
    batches: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        batches.append(number)

    q = result.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{spool.root}/progress").foreachBatch(write).start()
    q.awaitTermination()
    if not batches:
        return result.sparkSession.createDataFrame([], result.schema)
    chosen = batches[-1:] if mode == "complete" else sorted(set(batches))
    return result.sparkSession.read.schema(result.schema).parquet(*(f"{out}/{n}" for n in chosen))
