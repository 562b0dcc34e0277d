"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotledger.llm.common import cut

#: Salts of a node's links when they are dealt out again, so that a node of many links is no single task's.
SALTS = 16


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: a, b. Each node's neighbours are linked to the least of them and itself: the larger neighbours, or the smaller."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    # A node's least neighbour is copied to every salt; its links are spread over them.
    salted = both.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    copies = least.withColumn("_salt", F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALTS)))))
    joined = salted.join(copies, ["a", "_salt"])
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: columns a, b of one orderable type. A row for each node that has a link: node, root (the least node that it reaches).

    Nulls are not nodes; loops and repeated links change nothing; no links give no rows. Each round is cut by a
    checkpoint, and the number of rounds grows with the logarithm of the longest path.
    """
    now = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    for _ in range(rounds):
        now = cut(_star(_star(now, large=True), large=False))
        seen, mark = mark, _mark(now)
        if seen == mark:
            break
    else:
        raise RuntimeError(f"the links did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _mark(links: DataFrame) -> tuple:
    """Two sets of links with one mark are the same but for a chance of about 2^-60."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())
