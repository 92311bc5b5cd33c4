"""Rule sets that change while they are used, and sinks of streams, in a shared folder.

A new rule set is staged as a file of its own, checked as a whole, and published by one rename of a pointer. Who reads
follows the pointer, so it has the old rules or the new ones, never a part, and a bad update changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.net import prefix_range
from ..functions.regex import translate
from ..plans.rules import Logical, Rule, RuleError, RuleSet, parse_rule_set

POINTER = "CURRENT"


class _Folder:
    """A folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.conf, self.path = spark._jvm, spark._jsc.hadoopConfiguration(), path.rstrip("/")
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def write(self, name: str, text: str, overwrite: bool = False) -> None:
        out = self.fs.create(self.at(name), overwrite)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        """The names of the files in a folder, without what follows their dot."""
        return [x.getPath().getName().split(".")[0] for x in self.fs.listStatus(self.at(folder))] if self.fs.exists(self.at(folder)) else []

    def move(self, name: str, to: str) -> None:
        """One step: `to` is the old file or the new one at any time."""
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        kinds = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at("").toUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        kinds.rename(self.at(name), self.at(to), options)


def publish(spark: SparkSession, folder: str, text: str) -> int:
    """Make a rule set in source form the current one; gives its version, counted from 1.

    A text that is no valid rule set is an error, and so is a version that another writer has staged meanwhile;
    what is current stays so in both cases.
    """
    try:
        for rule in parse_rule_set(text).rules:
            _check_values(rule)
    except (ValueError, TypeError, KeyError) as e:
        raise e if isinstance(e, RuleError) else RuleError(str(e)) from e
    f = _Folder(spark, folder)
    version = 1 + max(map(int, f.names("versions")), default=0)  # one that was staged and never published is passed over
    f.write(f"versions/{version}.json", text)  # fails where the file is there already
    staged = f".{POINTER}-{uuid.uuid4().hex}"
    f.write(staged, str(version))
    f.move(staged, POINTER)
    return version


def _check_values(rule: Rule) -> None:
    if isinstance(rule, Logical):
        for r in rule.rules:
            _check_values(r)
        return
    for name, wanted in rule.fields.items():
        for x in wanted if isinstance(wanted, (list, tuple)) else [wanted]:
            if name.endswith("_regex"):
                translate(x)
            elif name.endswith("ip_cidr"):
                prefix_range(x)
            elif name in ("port", "source_port") and not (isinstance(x, int) and 0 <= x <= 65535):
                raise RuleError(f"bad port: {x}")


def current(spark: SparkSession, folder: str) -> tuple[int, RuleSet] | None:
    """The version that is current, and its rules; None before the first."""
    f = _Folder(spark, folder)
    version = f.read(POINTER)
    return None if version is None else (int(version), parse_rule_set(f.read(f"versions/{version}.json")))


def to_batches(stream: DataFrame, path: str, checkpoint: str, make: Callable[[DataFrame], DataFrame] | None = None, kind: str = "parquet") -> StreamingQuery:
    """Starts a query that writes each micro-batch as a whole under its number, until all that is there is read.

    A batch that failed half-way or is replayed replaces its own folder, so rows are there once. make: what to write
    of a batch; it is called for each one, and so sees the rules that are current then.
    """

    def write(batch: DataFrame, number: int) -> None:
        (make(batch) if make else batch).write.mode("overwrite").format(kind).save(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def save_usage(usage: DataFrame, path: str) -> None:
    """The rows as one JSON document under a name, replaced by one rename: a reader has the old document or the new one.

    It is a summary of cells by user, model and week, a few thousand rows; a table that grows with traffic belongs in to_batches().
    """
    f = _Folder(usage.sparkSession, path.rsplit("/", 1)[0])
    name = path.rsplit("/", 1)[1]
    rows = [json.loads(r) for r in usage.toJSON().collect()]
    staged = f".{name}-{uuid.uuid4().hex}"
    f.write(staged, json.dumps({"cells": rows}, indent=2))
    f.move(staged, name)
