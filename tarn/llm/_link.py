"""Links between rows that share a bucket, without listing the pairs of a bucket whose rows are linked already.

``members`` holds (key, id, ...) rows; two ids that share a key are candidates. Round one tests each id against one or
two pivots, so a bucket of n rows gives about n tests. A bucket's pivot is its member that meets most others over all
buckets: in a group of copies that is the text they were made from, or one near it, so the whole group joins at once
even where two of its copies differ too much to be links. Ids that are joined by found links form classes. Round two takes the buckets that
still hold several classes: the members of its largest class, and all others, are dealt over blocks of about ``BLOCK``.
Every two blocks meet in one task, but for two of the largest class, whose members are joined already; so a few strays in a
large bucket cost that bucket's size, not its square. A task tests all pairs of different classes and returns links
enough to span what it joined. No bucket is cut, no pair is listed outside a task, and content travels once for each
block it meets, not for each partner. Pairs within a class need no test, since components are what is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._store import Scratch


BLOCK = 256


def link(members: DataFrame, star: Callable[[DataFrame], DataFrame], blocks: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """(node, component) of every linked id. members: a written table (key, id), without repeated rows.

    star: takes (a, b) pairs, returns those that are links.
    blocks: takes (id, wants), wants being an array of (key, lo, hi, block, of), and returns links (a, b).
    """
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("x"), F.max("id").alias("y")).where("x != y")
    sized = members.select("key", "id").join(sizes.select("key", "n"), "key")
    meets = sized.groupBy("id").agg(F.sum("n").alias("meets"))
    ranked = scratch.put(members.select("key", "id").join(meets, "id"), "ranked")
    top = ranked.groupBy("key").agg(F.max(F.struct("meets", "id")).alias("top")).select("key", F.col("top.id").alias("pivot"), F.col("top.meets").alias("rank"))
    spokes = ranked.join(top, "key").where(F.col("id") != F.col("pivot"))
    first = (
        spokes.groupBy("id", "pivot")
        .agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("rank"))
        .groupBy("id")
        .agg(F.max(F.struct("rank", "pivot")).alias("best"), F.max(F.struct("n", "rank", "pivot")).alias("often"))
        .select(F.explode(F.array_distinct(F.array("best.pivot", "often.pivot"))).alias("a"), F.col("id").alias("b"))
    )
    first = scratch.put(first, "first")
    found = scratch.put(star(first), "found_first")
    classes = components(found, scratch, "cc_first")
    named = scratch.put(members.join(classes, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("of")), "named")
    many = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    parts = named.groupBy("key", "of").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "of")).alias("top")).where("n > top.c")
    small = F.col("n") <= BLOCK
    parts = parts.select("key", F.when(~small, F.col("top.of")).alias("main"), F.when(small, 0).otherwise(many(F.col("top.c"))).alias("mains"), F.when(small, 1).otherwise(many(F.col("n") - F.col("top.c"))).alias("others"))
    is_main = F.coalesce(F.col("of") == F.col("main"), F.lit(False))
    dealt = named.join(parts, "key").withColumn("block", F.when(is_main, F.pmod(F.xxhash64("id", F.lit(1)), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("id", F.lit(1)), F.col("others"))).cast("int"))
    want = F.struct("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "of")
    met = F.sequence(F.when(is_main, F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1)
    wants = dealt.withColumn("other", F.explode(met)).groupBy("id").agg(F.collect_list(want).alias("wants"))
    links = scratch.put(found.unionByName(blocks(wants)), "links")
    scratch.drop("ranked", "named", "first", "found_first")
    return components(links, scratch, "cc_all")


def spanning(of: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Links (places i < j of a boolean matrix) enough to join all classes that ``linked`` joins."""
    i, j = np.nonzero(np.triu(linked, 1))
    if not len(i):
        return []
    names, code = np.unique(of, return_inverse=True)
    lo, hi = np.minimum(code[i], code[j]), np.maximum(code[i], code[j])
    _, first = np.unique(lo * len(names) + hi, return_index=True)
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k in first:
        a, b = root(int(lo[k])), root(int(hi[k]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(i[k]), int(j[k])))
    return out


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in their first ``n_keys`` columns; batches must be sorted by those."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:n_keys] != row[:n_keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def fetches(pairs: DataFrame, most: int = 256) -> DataFrame:
    """(id, wants): which groups need an id's content. A group is a pivot with at most about ``most`` partners.

    A pivot with more partners is dealt over as many groups as it needs, so no task holds an unbounded group.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("n"))
    dealt = pairs.join(counts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("n")).cast("int"))
    as_partner = dealt.select(F.col("b").alias("id"), F.struct("a", "salt", F.lit(1).alias("role")).alias("want"))
    as_pivot = counts.select(F.col("a").alias("id"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"), "a").select(
        "id", F.struct("a", "salt", F.lit(0).alias("role")).alias("want")
    )
    return as_partner.unionByName(as_pivot).groupBy("id").agg(F.collect_list("want").alias("wants"))
