"""Connected components of a large edge table (DataFrame functions only).

Alternating large-star and small-star rounds: every node points its larger (then
its smaller) neighbours to the smallest one it knows, until all edges are stars.
Each round is written to the shared folder.  Only edges are shuffled; a node's
minimum is a partial aggregate, so a node with very many neighbours is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptspread.llm.common import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Point the larger (small: the smaller) neighbours of every node, itself included, to its smallest one."""
    both = edges.select(F.col("u"), F.col("v")) if small else edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    pointed = both.join(lowest, "u").select(F.col("v").alias("x"), "m", "u")
    kept = pointed.select("x", "m") if small else pointed.where(F.col("x") > F.col("u")).select("x", "m")
    own = lowest.select(F.col("u").alias("x"), "m")
    return kept.unionByName(own).where(F.col("x") > F.col("m")).select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest reachable node, for every node of an edge of (a, b)."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, last = stored(pairs, "edges_0"), None
    state = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first())
    mark, round_ = state(now), 0
    while mark != last:
        round_ += 1
        now, last = stored(_star(_star(now, False), True), f"edges_{round_}"), mark
        mark = state(now)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
