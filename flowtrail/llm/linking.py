"""Groups of linked members without all pairs: pivots first, then only what they left apart.

Members that may link share a bucket. In each bucket the first member is the pivot, and every other is
compared with it: as many pairs as members. Buckets whose members are then in one component need nothing
more. Buckets of a few members can do without: their pairs are compared at once. While the others would need many more pairs than they have members, and pivots settle most of them,
they get another pivot each. At last each member outside its bucket's largest component is compared with those of other components. So
a dense group costs about as much as its members, and no link between components is lost: of two linked
members in different components at least one is outside the bucket's largest. Where a bucket keeps so many
components that this were too many pairs, it is split by a finer key, of which any two members that link share one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, forget, table

Fits = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node it is connected to.

    Alternates large-star and small-star steps; each works on (node, neighbour) rows with partial
    minima, so a node with very many neighbours is no single task's group. A loop of a node is no edge.
    One table is written for each iteration, and the one before removed.
    """
    ordered = lambda a, b: (F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    edges = table(edges.where("a <> b").select(*ordered("a", "b")).distinct(), "cc")
    while True:
        # Done once every node is either a root or has one edge, to a root.
        nodes = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_nodes = nodes.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where((F.col("up") > 1) | (F.col("up") == 1) & (F.col("down") == 1))
        if not open_nodes.limit(1).count():
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").where("b <> m").select(*ordered("b", "m")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        previous, edges = edges, table(small.select(*ordered("a", "b")).where("a <> b").distinct(), "cc")
        forget(previous)


#: Pairs for each row of the index up to which what the pivots left apart is compared, and rounds of pivots at most.
PAIRS_A_ROW, ROUNDS = 4, 6
#: Pairs for each row from which what is left is split by a finer key, which takes some rows for each row itself.
FINER = 32


def linked(index: DataFrame, bucket: list[str], member: str, order: list[str], fits: Fits, links: Callable[[DataFrame], DataFrame] | None = None, direct: int = 1, finer: Callable[[DataFrame], DataFrame] | None = None, known: DataFrame | None = None) -> DataFrame:
    """(node, root) of every member that links with another: root is the smallest member it reaches.

    index: a row for each bucket that a member is in, with the columns that `order` and `fits` name. order:
    what makes a member its bucket's pivot, smallest first. fits: whether two rows of a bucket, read through
    two getters, are worth comparing. links: of pairs (a, b), a < b, those that link; None if all that fit do.
    direct: members of a bucket up to which it needs no pivots, its few pairs being compared at once.
    known: (node, root) of members that are known to be connected; they need no comparison with each other, and the result has them too.
    finer: adds a column `finer` to rows of the index, and rows with it; any two members that link share a value in a bucket in which they fit.
    """
    of = lambda side: lambda c: F.col(f"{side}.{c}")
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    together = _all([F.col(f"x.{c}") == F.col(f"y.{c}") for c in bucket]) & fits(of("x"), of("y"))
    compare = links or (lambda pairs: pairs)

    sizes = index.groupBy(*bucket).agg(F.count("*").alias("n")).where(F.col("n") > direct).drop("n")
    made, roots = None, known
    if direct > 1:  # chance brings most of these together, so hardly a pair of them fits
        sizes = few(table(sizes, "link-large"))
        small = index.join(sizes, bucket, "left_anti")
        pairs = small.alias("x").join(small.alias("y"), together & (F.col(f"x.{member}") < F.col(f"y.{member}")))
        made = table(pairs.select(F.col(f"x.{member}").alias("a"), F.col(f"y.{member}").alias("b")).distinct(), "link-pairs")
        new = compare(made)
        roots = table(components(new if known is None else new.unionByName(_edges(known))), "link-roots")
    rest = index.join(sizes, bucket)
    if known is not None:
        rest = rest.join(known.withColumnRenamed("node", member), member, "left").withColumn("root", F.coalesce("root", member))
    rest = table(rest, "link-index")
    columns, rows = [c for c in rest.columns if c not in (*bucket, "root")], rest.count()
    if roots is not None and not rows:
        return roots
    for k in range(ROUNDS):
        root = [c for c in ("root",) if c in rest.columns]
        first = F.struct(*order, *[c for c in columns if c not in order], *root) if k == 0 else F.struct(F.xxhash64(member, F.lit(k)), *columns, *root)
        names = [f.name for f in rest.select(first.alias("p")).schema["p"].dataType.fields]
        apart = F.col("x.root") != F.col("y.root") if root else F.col(f"x.{member}") != F.col(f"y.{member}")
        pivots = rest.groupBy(*bucket).agg(F.min(first).alias("p")).select(*bucket, *[F.col(f"p.{n}").alias(n) for n in names if n in columns or n in root])
        pairs = rest.alias("x").join(pivots.alias("y"), together & apart).select(*ordered(f"x.{member}", f"y.{member}")).distinct()
        pairs = table(pairs.join(made, ["a", "b"], "left_anti") if made is not None else pairs, "link-pairs")
        made = pairs if made is None else made.unionByName(pairs)
        new = compare(pairs)
        roots = table(components(new if roots is None else new.unionByName(_edges(roots))), "link-roots")
        # An index row carries its component; buckets with one only are done.
        rooted = rest.select(*bucket, *columns).join(roots.withColumnRenamed("node", member), member, "left").withColumn("root", F.coalesce("root", member))
        tally = rooted.groupBy(*bucket, "root").agg(F.count("*").alias("n"))
        mixed = tally.groupBy(*bucket).agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots"), F.sum("n").alias("all")).where("roots > 1")
        previous, rest = rest, table(rooted.join(mixed.select(*bucket, F.col("top.root").alias("largest"), (F.col("all") - F.col("top.n")).alias("apart")), bucket), "link-rest")
        forget(previous)
        before, (rows, pairs_left) = rows, rest.agg(F.count("*"), F.coalesce(F.sum(F.col("apart").cast("double")), F.lit(0.0))).first()
        if pairs_left <= PAIRS_A_ROW * rows or 2 * rows > before:
            break
    if not rows:
        return roots

    if finer and pairs_left > FINER * rows:
        rest = table(finer(rest), "link-finer")
        together = together & (F.col("x.finer") == F.col("y.finer"))
    pairs = rest.where("root <> largest").alias("x").join(rest.alias("y"), together & (F.col("x.root") != F.col("y.root")))
    if links:
        pairs = table(pairs.select(*ordered(f"x.{member}", f"y.{member}")).distinct().join(made, ["a", "b"], "left_anti"), "link-pairs")
    else:  # one link to each other component is enough
        pairs = pairs.groupBy(F.col(f"x.{member}").alias("a"), F.col("y.root").alias("other")).agg(F.min(f"y.{member}").alias("b")).select(*ordered("a", "b")).distinct()
    return table(components(_edges(roots).unionByName(compare(pairs))), "link-roots")


def _edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("root").alias("a"), F.col("node").alias("b"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
