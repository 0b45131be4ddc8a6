"""Connected components of a graph of links, as smallest node reachable, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Workspace, salted_join

def components(work: Workspace, edges: DataFrame, rounds: int = 64) -> DataFrame:
    """edges (a long, b long) to (node, component) for every node that has a link to another.

    Large star: each node's larger neighbours link to its smallest one. Small star: its smaller neighbours
    and itself do. When nothing changes every edge leads from a node to its component's smallest. Each
    round is written to the shared folder. Least neighbours are partial minima, and the links of a node with very many
    are split where they meet it, so they never gather in one task.
    No edges give no rows; edges of a node with itself, and repeated ones, change nothing.
    """
    now = work.store(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "cc")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")).select("u", F.least("u", "m").alias("m"), "_n")
        large = salted_join(work, both.where("v > u"), least.drop("_n"), ["u"], F.col("v"), counts=least.select("u", "_n")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        large = work.store(large, "cc-large")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("_n"))
        joined = salted_join(work, large, least.drop("_n"), ["hi"], F.col("lo"), counts=least.select("hi", "_n"))
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").union(least.select("hi", F.col("m").alias("lo"))).distinct()
        old, now = now, work.store(small, "cc")
        work.drop(old, large)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def _state(edges: DataFrame) -> tuple:
    """A few numbers that tell whether a round changed anything."""
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.sum((F.xxhash64("lo", "hi") % 1_000_003).cast("long"))).first()
    return tuple(r)
