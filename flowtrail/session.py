"""Session settings that the library's results rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Time stamps in results and labels are in UTC. Stages whose code is longer than the JVM compiles (8,000 bytes) are generated in parts, which it does.
#: A Python worker gets a few MB of rows at a time (or one longer row); 10,000 long texts would be held by the JVM and the worker at once.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS, and let Python workers find this package where it isn't installed (local mode, shared folders).

    On a cluster without shared code folders, install the package or pass it with --py-files.
    """
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    top, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if top not in paths:
        env["PYTHONPATH"] = os.pathsep.join([top, *filter(None, paths)])
    return spark


_local: str | None = None


def shared(spark: SparkSession, name: str) -> str:
    """A new folder's path under the one in spark.checkpoint.dir, which driver and executors share; a local master may do without the setting."""
    global _local
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _local = base = _local or "file://" + tempfile.mkdtemp(prefix="flowtrail-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to a shared folder and read back, which cuts its plan."""
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Lookup tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, which is counted and not assumed."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
