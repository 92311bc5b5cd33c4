"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once for each document. The ledger keeps the measurements and one LONG in
which bit k says that rule k failed. A policy is a named mask over those bits, so applying another
policy, or asking what a rule alone removes, is integer arithmetic over the ledger: no text is read
again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, let, shared_dir, words

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Rule k fails where the k-th predicate, over a getter of measurements, holds. Append only: stored
#: bits keep their meaning.
RULES = (
    ("few_words", lambda m: m("n_words") < 10),
    ("repeated_words", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
    ("symbols", lambda m: m("n_symbols") > m("n_words")),
    ("duplicate_lines", lambda m: 2 * m("n_dup_lines") > m("n_lines")),
    ("word_length", lambda m: m("word_chars") > 40 * m("n_words")),
)
#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols"),
    "v2": ("few_words", "repeated_words", "symbols", "duplicate_lines", "word_length"),
}
CURRENT = "v2"


def mask(policy: str | tuple[str, ...]) -> int:
    """The bits of a policy, given by name or as rule names."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    order = [name for name, _ in RULES]
    return sum(1 << order.index(name) for name in set(names))


def _repeat_words(w: Column) -> Column:
    """Words that lie in a WINDOW-word window found twice or more in w.

    Windows are compared by a 64-bit hash of their words first. Only a text that has a repeated hash pays
    for the sort that finds where the repeats are; that sort compares the words themselves.
    """
    n = F.size(w) - F.lit(WINDOW - 1)
    at = lambda i, k: F.element_at(w, (i + k).cast("int"))
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), F.slice(w, i + 1, WINDOW).alias("five"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, j: F.coalesce((F.get(s, j)["h"] == x["h"]) & (F.get(s, j)["five"] == x["five"]), F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

        def total(p: Column) -> Column:
            gaps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(pairs, lambda s: let(starts(s), total))

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(n >= 2, some).otherwise(F.lit(0).cast("long"))


def _measures(t: Column) -> Column:
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    of_words = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    chars = F.length(F.translate(t, SPACES, "")).cast("long")
    symbols = (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long")
    return F.struct(of_words.alias("w"), of_lines.alias("l"), chars.alias("chars"), symbols.alias("symbols"))


#: Where _measures has each measurement.
FIELDS = {"n_words": "w.n", "word_chars": "chars", "n_symbols": "symbols", "n_dup_lines": "l.dup", "n_repeat_words": "w.r", "n_lines": "l.n"}


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measurements and fail_bits, one row for each input row.

    A null or empty text measures zero everywhere and fails few_words. Repeated rows and ids give a
    row each; other columns are not read. A document of any length is measured whole, in its own row.
    """
    t, m = fresh("t"), fresh("m")
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(t)).select(id_col, _measures(F.col(t)).alias(m))
    rows = rows.select(id_col, *[F.col(f"{m}.{field}").alias(name) for name, field in FIELDS.items()])
    return rows.withColumn("fail_bits", _bits(F.col))


def _bits(m) -> Column:
    bits = F.lit(0).cast("long")
    for k, (_, failed) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(failed(m), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quality-ledger/{name}"


def store(ledger_df: DataFrame, name: str) -> DataFrame:
    """Keep a ledger under a name in the shared folder, with the number of rules that its bits stand for, and read it back."""
    ledger_df.withColumn("n_rules", F.lit(len(RULES))).write.mode("overwrite").parquet(_folder(ledger_df.sparkSession, name))
    return stored(ledger_df.sparkSession, name)


def stored(spark: SparkSession, name: str) -> DataFrame:
    """A kept ledger. Rules are only ever appended, so its bits keep their meaning."""
    return spark.read.parquet(_folder(spark, name))


def fails(policy: str | tuple[str, ...]) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def apply_policy(ledger_df: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds base_failed, kept and policy. The base rules hold under every policy, so base_failed implies not kept.

    A stored ledger that was made before one of the policy's rules came in can't answer it: its rows fail with an error.
    """
    out = ledger_df
    if "n_rules" in out.columns:
        old = F.pow(F.lit(2), F.col("n_rules")) <= F.lit(mask("base") | mask(policy))
        out = out.withColumn("fail_bits", F.when(old, F.raise_error(f"the ledger is older than policy {policy}").cast("long")).otherwise(F.col("fail_bits"))).drop("n_rules")
    return out.withColumns({"base_failed": fails("base"), "kept": ~(fails("base") | fails(policy)), "policy": F.lit(policy)})


def ablation(ledger_df: DataFrame, policy: str = CURRENT) -> DataFrame:
    """rule, n_failed, n_only for each rule of a policy: documents that fail it, and documents that only it rejects.

    The first aggregate leaves at most one row for each combination of bits, whatever the input's
    size; the rest is arithmetic on those.
    """
    combos = ledger_df.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")).alias("b")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, (name, _) in enumerate(RULES) if name in POLICIES[policy]])
    return (
        combos.select("b", "n", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("b").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("b") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )


def keep(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of docs that a policy keeps, every column as it was; the same bits and mask decide."""

    def field(x: Column, name: str) -> Column:
        for part in FIELDS[name].split("."):
            x = x[part]
        return x

    bits = let(_measures(F.coalesce(F.col("text"), F.lit(""))), lambda x: _bits(lambda name: field(x, name)))
    return docs.where(bits.bitwiseAND(F.lit(mask("base") | mask(policy)).cast("long")) == 0)
