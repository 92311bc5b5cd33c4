"""Spelling variants by anagram hashing: words that differ in one letter, and the form that each is a variant of.

A word's key is the sum of a power of its letters, so anagrams share it and one letter more, less or
other changes it by a known value. Two words whose keys differ by the value of one letter, or by the
difference of two letters' values, may be near. Each word is stored under its key and under its key
less each of its letters: words that one letter added or removed sets apart meet where one's key is the other's less that
letter, words that an exchange sets apart where both are less the letters exchanged. So the differences
are joined by equality, with a row for each letter of a word, not one for each exchange there could be.
The order of letters is verified for the pairs that meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, forget, table

#: A run of letters, as long as a word must be at least; shorter runs make no word.
LETTERS, SHORTEST = r"A-Za-zÀ-ÿ", 6
RUN = rf"[{LETTERS}]{{{SHORTEST},}}"
#: One run of a document in ERRORS, by its checksum, loses a letter: these are the misspellings to find.
ERRORS = 199
#: A word counts from LEAST occurrences on; a form has TIMES those of its variant at least.
LEAST, TIMES = 5, 5
#: Keys are sums modulo a prime, so words of any length have one.
POWER, MODULUS = 5, (1 << 61) - 1


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n for every word of SHORTEST letters and LEAST occurrences at least.

    A-Z are lower-cased, no other letter is. A null id stands for an empty one in the checksum. Null and
    empty texts have no words; a text of any length is read whole. Occurrences are counted before anything is shuffled.
    """
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(name.alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", ascii_lower(F.col("run")).alias("run"))
    crc = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (crc % F.length("run")).cast("int")
    word = F.when(crc % ERRORS == 0, F.concat(F.expr("left(run, at)"), F.expr("substring(run, at + 2)"))).otherwise(F.col("run"))
    made = runs.withColumn("at", at).select(word.alias("word")).where(F.length("word") >= SHORTEST)
    return made.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)


def letter_value(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")  # the code point
    out = code
    for _ in range(POWER - 1):
        out = out * code
    return out


def keyed(vocabulary: DataFrame) -> DataFrame:
    """word, n and key of each word."""
    key = F.aggregate(F.split("word", ""), F.lit(0).cast("long"), lambda a, x: F.when(x == "", a).otherwise((a + letter_value(x)) % MODULUS))
    return vocabulary.select("word", "n", key.alias("key"))


def index(keys: DataFrame) -> DataFrame:
    """A row for each word's key (letter null) and one for each of its letters, under the key without it."""
    less = F.transform(F.array_distinct(F.filter(F.split("word", ""), lambda x: x != "")), lambda x: F.struct(F.pmod(F.col("key") - letter_value(x), F.lit(MODULUS)).alias("at"), x.alias("letter")))
    whole = F.array(F.struct(F.col("key").alias("at"), F.lit(None).cast("string").alias("letter")))
    return keys.select("word", "n", F.explode(F.concat(whole, less)).alias("i")).select("word", "n", "i.at", "i.letter")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n), a < b, for all words (distinct; word, n) that one letter added, removed or exchanged sets apart, each pair once."""
    made = index(keyed(vocabulary))
    # Spark takes the size of the exploded rows for little more than the vocabulary's: never to be broadcast.
    x, y = made.alias("x"), made.hint("merge").alias("y")
    met = (F.col("x.at") == F.col("y.at")) & (F.col("x.word") < F.col("y.word")) & (F.col("x.letter").isNotNull() | F.col("y.letter").isNotNull())
    # Sums of different letters may agree: the letters taken away must be those that one word has more of.
    more = lambda p, q: F.col(f"{p}.letter").isNull() | (_times(p, p) == _times(q, p) + 1)
    near = (F.levenshtein("x.word", "y.word", 1) == 1) & more("x", "y") & more("y", "x")
    return x.join(y, met & near).select(F.col("x.word").alias("a"), F.col("x.n").alias("a_n"), F.col("y.word").alias("b"), F.col("y.n").alias("b_n"))


def _times(word: str, letter: str) -> Column:
    return F.length(f"{word}.word") - F.length(F.replace(F.col(f"{word}.word"), F.col(f"{letter}.letter")))


def forms(vocabulary: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of vocabulary (word, n).

    form: the near word of the largest n, the first in code-point order of several, if it has TIMES the
    word's n at least; else null. root: where following forms ends, the word itself if it has none. An empty
    vocabulary gives an empty result.
    """
    vocabulary = table(vocabulary.select("word", "n"), "variant-words")
    sides = F.explode(F.array(*[F.struct(F.col(a).alias("word"), F.struct((-F.col(f"{b}_n")).alias("less"), F.col(b).alias("form")).alias("near")) for a, b in (("a", "b"), ("b", "a"))]))
    best = near_pairs(vocabulary).select(sides.alias("s")).groupBy("s.word").agg(F.count("*").alias("n_near"), F.min("s.near").alias("best"))
    is_form = -F.col("best.less") >= TIMES * F.col("n")
    known = table(
        vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")),
        "variant-forms",
    )
    out = known.join(roots(known.where("form is not null").select("word", "form")).hint("merge"), "word", "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def roots(chosen: DataFrame) -> DataFrame:
    """word and root for each row of chosen (word, form): each step doubles the distance, and n grows TIMES-fold with each form."""
    at = table(chosen.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = table(at.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
        forget(at)
        at = step.select("word", "root")
        at._folder = step._folder
        if not step.where("moved").limit(1).count():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """forms() of the words of docs. Columns of docs other than these two are not read; repeated rows count each."""
    return forms(words(docs, id_col, text_col))
