"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a minimum by node (summed in each task first) and a join, which adaptive execution splits for a node with
very many links. Rounds are written to the shared folder, so a lost executor costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.session import materialize


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a")
    return moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)`` but the roots; the root is the smallest node reachable.

    Links may repeat, point either way or to themselves (those say nothing); null ends are left out.
    """
    tidy = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("whole")).where("whole and a <> b")
    now = materialize(tidy.select("a", "b").distinct())
    digest = F.struct(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x"))
    mark = now.agg(digest.alias("d")).first()["d"]
    while mark["n"]:
        now = materialize(_small(_large(now).distinct()).distinct())
        last, mark = mark, now.agg(digest.alias("d")).first()["d"]
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
