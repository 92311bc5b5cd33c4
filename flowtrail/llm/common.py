"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Keys up to this many (some 50 MB at most) are broadcast, after they were counted; more are joined by shuffle.
BROADCAST_KEYS = 500_000
_fallback: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own on a local master.

    Elsewhere the setting is needed: a folder of one machine would lose what other machines wrote.
    """
    global _fallback
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _fallback is None:
        _fallback = "file://" + tempfile.mkdtemp(prefix="flowtrail-")
    return _fallback


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    This cuts the lineage: a lost executor costs its own tasks, not the whole history, and later
    stages read the narrow result rather than the texts again. forget() removes what nothing reads any
    more; what a returned frame reads stays, as checkpoint files do.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._folder = path
    return back


def forget(*tables: DataFrame) -> None:
    """Remove the folders of tables that no later read needs."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._folder)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def quoted(*names: str) -> list[Column]:
    """The columns of these names, whatever letters the names have."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def fresh(name: str) -> str:
    """A column name that no input has."""
    return f"_{name}_{uuid.uuid4().hex[:12]}"


def few(keys: DataFrame) -> DataFrame:
    """keys with a broadcast hint if they are at most BROADCAST_KEYS, which is counted and not assumed."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def without(rows: DataFrame, key: str, gone: DataFrame, again: DataFrame) -> DataFrame:
    """rows without the keys of `gone` and with one row of each key of `again`; both hold the column key.

    Rows move only if the keys are too many to broadcast, or if theirs is one of `again`.
    """
    again = again.distinct()
    if not again.limit(1).count():
        return rows.join(few(gone), key, "left_anti")
    rest = rows.join(few(gone.unionByName(again)), key, "left_anti")
    return rest.unionByName(rows.join(few(again), key, "left_semi").dropDuplicates([key]))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: a lambda variable is never inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
