"""Session settings and the shared folder for tables that cut a lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g", **settings: str) -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory} | settings
    spark = SparkSession.builder.master(f"local[{cores}]").appName("tidegraph").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python, once per application, so that nothing needs to be installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="tidegraph-code-")
    path = os.path.join(folder, "tidegraph_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def col(name: str) -> Column:
    """The column of exactly this name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is named, a folder of this machine, but only if the session runs on it alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidegraph-")
        spark.sparkContext.setCheckpointDir(named)
        atexit.register(_delete, spark, named)
    return named


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended before  # noqa: BLE001
        pass


class Spool:
    """Tables written to the shared folder: they survive a lost executor and cut the lineage.

    A table is deleted by ``drop`` once another has taken its place, all that are left when the driver ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/spool-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(_delete, spark, self.root)

    def write(self, df: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, str]:
        """The table that df was written to, partitioned by columns if given, and its path."""
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path, partitionBy=by)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, *paths: str) -> None:
        for path in paths:
            _delete(self.spark, path)
