"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, settle, sized


def _large(links: DataFrame, n: int) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = sized(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), 2 * n)
    return sized(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), n)


def _small(links: DataFrame, n: int) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sized(down.groupBy("a").agg(F.min("b").alias("m")), n)
    return sized(down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), n).union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node it reaches) for every node of links (a, b: long) but the roots.

    Each round joins every node's neighbours to the least among them and writes the links anew, so
    neither a component nor the links ever lie in one task; rounds grow as the logarithm of the
    longest path. Minima are taken before the shuffle, and large nodes are split by skew joins.
    Links of a node with itself and repeated links count for nothing; without links there is no row.
    """
    mark = {"sum": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    now, before = settle(links.select("a", "b").filter("a <> b").distinct(), "links", **mark)
    while before.rows:
        wide = sized(_large(now, before.rows).filter("a <> b").distinct(), before.rows)
        later, after = settle(sized(_small(wide, before.rows).filter("a <> b").distinct(), before.rows), "links", **mark)
        discard(now)
        now = later
        if after == before:
            break
        before = after
    return now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
