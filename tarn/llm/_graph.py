"""Connected components by alternating star contractions, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(a, b) links to (node, component): the smallest node that each linked node reaches.

    Large-star then small-star until nothing changes; each round is two aggregations and two joins on node keys, so
    hot nodes are pre-aggregated before the shuffle and split by skew handling after it. Rounds grow with the
    logarithm of the longest chain. Self links and repeated links are ignored; no links give an empty table.
    """
    cur = scratch.put(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        f"{name}_0",
    )
    before, step = None, 0
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        step += 1
        cur = scratch.put(small, f"{name}_{step}")
        scratch.drop(f"{name}_{step - 1}")
        row = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if row == before or row[0] == 0:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = row
