"""Tables of patterns matched against tables of texts through an inverted index of trigrams.

A pattern needs certain texts (functions/regex.py): of each group of them one must occur. Of a needed text
the trigram that the fewest rows have is its key, of the groups the one whose keys are rarest counts, and
a pattern with a key that no row has can't match. Rows explode into their trigrams and meet patterns by
equality; what meets is verified. So no list size asks for a nested loop, and the bounds of a text are letters
of it: a text's end is as good a key as its middle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import regex
from ..session import small, written

#: Letters of a key; what is shorter is a key as it is.
GRAM = 3
#: Patterns that need no text at all meet every row; they and the rows are dealt to so many keys.
SALTS = 64


def compiled(patterns: DataFrame, column: str = "pattern") -> DataFrame:
    """patterns with java, null where the pattern has no meaning, and needs, groups of texts."""
    fields = [T.StructField("java", T.StringType()), T.StructField("needs", T.ArrayType(T.ArrayType(T.StringType())))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            java, needs = [], []
            for p in batch[column].to_pylist():
                try:
                    part = regex.read(p)
                    java.append(part.java)
                    needs.append([sorted(g) for g in part.required()])
                except (ValueError, TypeError):  # it has no meaning, or is null
                    java.append(None)
                    needs.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(java, pa.string()), pa.array(needs, pa.list_(pa.list_(pa.string())))], [*batch.schema.names, "java", "needs"])

    return patterns.mapInArrow(read, T.StructType(patterns.schema.fields + fields))


def quoted(text: Column) -> Column:
    """A pattern that finds the text as it is."""
    return F.regexp_replace(text, r"([\x00-/:-@\[-`{-\x7f])", r"\\$1")


def _cut(text: Column, size: int) -> Column:
    return F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.expr("cast(array() as array<string>)"))


def _keys_of_row(text: Column) -> Column:
    padded = F.concat(F.lit(regex.START), text, F.lit(regex.END))
    salt = F.array(F.concat(F.lit("\x00"), F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("string")))
    return F.concat(salt, F.array_distinct(F.flatten(F.array(*[_cut(padded, n) for n in range(1, GRAM + 1)]))))


def matches(rows: DataFrame, patterns: DataFrame, text: str = "host") -> DataFrame:
    """(text, and every column of patterns but `pattern`) for each text of rows and each pattern that is found in it, each once.

    Texts are not null. A pattern that has no meaning is passed over, whatever the size of the list.
    """
    carried = [c for c in patterns.columns if c != "pattern"]
    rules = written(compiled(patterns.distinct()).where("java is not null").drop("pattern").distinct().withColumn("_id", F.monotonically_increasing_id()), "patterns")
    found = rows.select(text).distinct().select(text, F.explode(_keys_of_row(F.col(text))).alias("_key"))
    needed = rules.select("_id", F.posexplode("needs").alias("_group", "_texts")).select("_id", "_group", F.posexplode("_texts").alias("_at", "_text"))
    grams = F.when(F.length("_text") < GRAM, F.array("_text")).otherwise(_cut(F.col("_text"), GRAM))
    needed = written(needed.select("_id", "_group", "_at", F.explode(grams).alias("_key")), "pattern-grams")
    often = found.join(small(needed.select("_key").distinct()), "_key", "left_semi").groupBy("_key").agg(F.count("*").alias("_n"))
    rarest = needed.join(often, "_key", "left").groupBy("_id", "_group", "_at").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_key").alias("key"))).alias("k"))
    groups = rarest.groupBy("_id", "_group").agg(F.sum("k.n").alias("cost"), F.collect_set(F.when(F.col("k.n") > 0, F.col("k.key"))).alias("keys"))  # regex.MOST keys at most
    chosen = groups.groupBy("_id").agg(F.min(F.struct("cost", "keys")).alias("g")).select("_id", F.explode("g.keys").alias("_key"))
    free = rules.where(F.size("needs") == 0).select("_id", F.explode(F.array(*[F.lit(f"\x00{k}") for k in range(SALTS)])).alias("_key"))
    keys = written(chosen.unionByName(free).join(rules.select("_id", "java", *carried), "_id").drop("_id"), "pattern-keys")
    return found.join(small(keys), "_key").where(F.regexp(text, F.col("java"))).select(text, *carried).distinct()
