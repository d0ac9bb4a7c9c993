"""Near-duplicate vectors by a forest of random-projection trees.

Each of ``TREES`` trees splits the unit vectors by random directions at the median of a bounded sample (at most
``SAMPLE`` rows, chosen by a hash), down to about ``LEAF`` sample rows' worth of data; a split sends what lies within
``SPILL`` of it to both sides. Every row is then led through every tree. Leaves that still hold more than ``LARGE`` rows
are split again, each by a sample of its own rows (about ``OWN``), and so on while that parts them: so leaves don't grow
with the table, but where rows are so alike that no plane parts them. Rows of a leaf are compared with each other by
exact cosines in double precision; leaves of more than ``BLOCK`` rows are dealt over blocks, and every two blocks meet in
one task, so no leaf is cut and no task holds an unbounded one. A pair that meets in several leaves counts in the first
only: a row carries the leaves it lies in, and a link counts where no earlier leaf is shared. Links become counts and
spanning links inside the task; no pair is listed outside it.

Vectors of equal components are collapsed first: a class is one row with its number of members.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do
vectors of different lengths; equal rows are links of each other; a null id has a null component and is kept; repeated
ids are rows of their own; columns besides id and vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components
from ._link import groups, spanning
from ._store import Scratch

COSINE, TREES, SPILL, SAMPLE, LEAF, BLOCK = 0.95, 8, 0.015, 20_000, 400, 2048
#: Rows of a leaf that is split again, rows of its sample, levels of such a split, and the share of a node's rows that a side may keep.
LARGE, OWN, LEVELS, SHARE = 8 * LEAF, 512, 4, 0.75


class Tree:
    """Directions come from a node's number, so a node is its threshold; node k has children 2k + 1 and 2k + 2."""

    def __init__(self, seed: int, sample: np.ndarray, rows: int):
        self.seed, self.dims = seed, sample.shape[1]
        depth = 0
        while rows / 2**depth > LEAF and len(sample) / 2**depth > 16:
            depth += 1
        self.depth = depth
        self.cut = np.zeros(2**depth - 1)
        held = {0: np.arange(len(sample))}
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                at = held.pop(node)
                p = sample[at] @ self.direction(node)
                self.cut[node] = np.median(p) if len(p) else 0.0
                held[2 * node + 1], held[2 * node + 2] = at[p <= self.cut[node]], at[p > self.cut[node]]

    def direction(self, node: int) -> np.ndarray:
        d = np.random.Generator(np.random.PCG64([self.seed, node])).standard_normal(self.dims)
        return d / np.linalg.norm(d)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every place that rows fall into."""
        held = {0: np.arange(len(x))}
        for level in range(self.depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                at = held.pop(node)
                if not len(at):
                    held[2 * node + 1] = held[2 * node + 2] = at
                    continue
                p = x[at] @ self.direction(node) - self.cut[node]
                held[2 * node + 1], held[2 * node + 2] = at[p <= SPILL], at[p > -SPILL]
        rows = [at for at in held.values()]
        return np.concatenate(rows), np.repeat(np.array(list(held), np.int64), [len(r) for r in rows])


def direction(seed: int, dims: int) -> np.ndarray:
    d = np.random.Generator(np.random.PCG64([977, seed])).standard_normal(dims)
    return d / np.linalg.norm(d)


def own_cuts(x: np.ndarray, n: int, directions: np.ndarray) -> np.ndarray:
    """Where each node of a small tree splits a leaf of n rows, from its sample x; nan where it doesn't part them."""
    cuts = np.full(2**LEVELS - 1, np.nan)
    held = {0: np.arange(len(x))}
    for node in range(len(cuts)):
        at = held.get(node)
        if at is None or n * len(at) / len(x) <= 2 * LEAF or len(at) < 32:
            continue
        p = x[at] @ directions[node]
        cut = np.median(p)
        left, right = at[p <= cut + SPILL], at[p > cut - SPILL]
        if max(len(left), len(right)) <= SHARE * len(at):
            cuts[node], held[2 * node + 1], held[2 * node + 2] = cut, left, right
    return cuts


def own_leaves(x: np.ndarray, cuts: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of every place that rows fall into; a row has the cuts of its own leaf."""
    p = x @ directions.T - cuts
    row, node, out = np.arange(len(x)), np.zeros(len(x), np.int64), []
    for _ in range(LEVELS + 1):
        inner = node < cuts.shape[1]
        side = np.full(len(row), np.nan)
        side[inner] = p[row[inner], node[inner]]
        end = np.isnan(side)
        out.append((row[end], node[end]))
        left, right = side <= SPILL, side > -SPILL  # false for nan
        row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left] + 1, 2 * node[right] + 2))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def unit(flat: np.ndarray, dims: int) -> np.ndarray:
    x = flat.reshape(-1, dims).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _pairs(batches: Iterator[pa.RecordBatch], dims: int, kind: type) -> Iterator[pa.RecordBatch]:
    """(leaf, lo, hi, block, id, many, places, v) to (id, linked vectors, other end or null)."""
    for rows in groups(batches, 3):
        name, many, block = np.array([r[4] for r in rows]), np.array([r[5] for r in rows]), np.array([r[3] for r in rows])
        x = unit(np.frombuffer(b"".join(r[7] for r in rows), kind), dims)
        linked = x @ x.T >= COSINE
        np.fill_diagonal(linked, False)
        if rows[0][1] != rows[0][2]:
            linked &= block[:, None] != block[None, :]
        i, j = np.nonzero(np.triu(linked))
        if len(i):
            # Every row's places up to this leaf, as a row of marks: a pair that shares an earlier one counted there.
            flat = np.concatenate([r[6] for r in rows])
            owner = np.repeat(np.arange(len(rows)), [len(r[6]) for r in rows])
            before = flat < rows[0][0]
            names, code = np.unique(flat[before], return_inverse=True)
            if len(names):
                marks = np.zeros((len(rows), len(names)), np.float32)
                marks[owner[before], code] = 1
                new = np.zeros(len(i), bool)
                for k in range(0, len(i), 4096):
                    p, q = i[k : k + 4096], j[k : k + 4096]
                    new[k : k + 4096] = np.einsum("ij,ij->i", marks[p], marks[q]) == 0
                i, j = i[new], j[new]
        n = np.bincount(i, many[j], len(rows)) + np.bincount(j, many[i], len(rows))
        fresh = np.zeros(linked.shape, bool)
        fresh[i, j] = True
        ties = spanning(np.arange(len(rows)), fresh)
        some = np.flatnonzero(n)
        a = np.concatenate((name[some], name[[t[0] for t in ties]] if ties else name[:0]))
        b = [None] * len(some) + [int(name[t[1]]) for t in ties]
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(np.concatenate((n[some], np.zeros(len(ties)))).astype(np.int64)), pa.array(b, pa.int64())], names=["id", "n", "other"])


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "vectors")
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one component; the name is of the exact components.
    name = F.when(sound & F.col("id").isNotNull(), F.sha2(F.to_json(F.transform("v", lambda x: x + F.lit(0.0))), 256))
    given = scratch.put(given.withColumn("name", name), "given")
    whole = given.where("name is not null")
    classes = whole.groupBy("name").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("many"))
    classes = scratch.put(classes, "classes")
    lead = whole.join(classes.select("rep", "many", F.col("name").alias("of")), (F.col("id") == F.col("rep")) & (F.col("name") == F.col("of"))).select("id", "many", "v")
    lead = scratch.put(lead.dropDuplicates(["id", "v"]), "lead")
    kind = np.float32 if rows.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64
    links = []
    for row in lead.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).collect():
        links.append(_forest(spark, lead.where(F.size("v") == row["dims"]), row["dims"], row["n"], kind))
    if links:
        found = links[0]
        for more in links[1:]:
            found = found.unionByName(more)
        found = scratch.put(found, "found")
        joined = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")), scratch)
        counts = found.groupBy("id").agg(F.sum("n").alias("n"))
        of = classes.join(counts, F.col("rep") == F.col("id"), "left").drop("id").join(joined, F.col("rep") == F.col("node"), "left")
        of = of.select("name", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("low"))
    else:
        of = classes.select("name", (F.col("many") - 1).alias("n_links"), F.col("rep").alias("low"))
    out = given.select("id", "name").join(of, "name", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("low", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def _forest(spark: SparkSession, lead: DataFrame, dims: int, n: int, kind: type) -> DataFrame:
    """Vectors travel in the precision ``kind`` that they came in, and are compared in double precision."""
    sample = lead.select("v").orderBy(F.xxhash64("id")).limit(SAMPLE).toArrow()["v"].combine_chunks()
    sample = unit(sample.values.to_numpy(), dims)
    trees = spark.sparkContext.broadcast([Tree(k, sample, n) for k in range(TREES)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                part = batch.slice(lo, 2048)
                raw = part.column(2).flatten().to_numpy()
                x = unit(raw, dims)
                row, leaf = [], []
                for k, tree in enumerate(trees.value):
                    r, l = tree.leaves(x)
                    row.append(r)
                    leaf.append(l + (k << 40))
                row, leaf = np.concatenate(row), np.concatenate(leaf)
                order = np.lexsort((leaf, row))
                row, leaf = row[order], leaf[order]
                ends = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
                bodies = pa.array([v.tobytes() for v in raw.reshape(-1, dims).astype(kind)], pa.binary())
                yield pa.record_batch([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(leaf)), bodies], names=["id", "many", "places", "v"])

    scratch = Scratch(spark, "forest")
    placed = scratch.put(lead.mapInArrow(place, "id bigint, many bigint, places array<bigint>, v binary"), "placed")
    placed = _split(placed, dims, kind, scratch)
    each = placed.select(F.explode("places").alias("leaf"), "id")
    sizes = each.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("k"))
    dealt = placed.select(F.explode("places").alias("leaf"), "id", "many", "places", "v").join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("leaf", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "many", "places", "v")
    dealt = dealt.repartition("leaf", "lo", "hi").sortWithinPartitions("leaf", "lo", "hi")
    return dealt.mapInArrow(lambda b: _pairs(b, dims, kind), "id bigint, n bigint, other bigint")


def _split(placed: DataFrame, dims: int, kind: type, scratch: Scratch) -> DataFrame:
    """``placed`` with its large leaves split by samples of their own rows, until nothing parts any more."""
    final = None  # leaves that no plane parts
    for step in range(16):
        directions = np.stack([direction(step * 64 + node, dims) for node in range(2**LEVELS - 1)])
        sizes = placed.select(F.explode("places").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE)
        if final is not None:
            sizes = sizes.join(final, "leaf", "left_anti")
        sizes = scratch.put(sizes, f"large_{step}")
        if sizes.isEmpty():
            return placed
        # (row, leaf) for large leaves; a leaf's sample are the rows whose hash falls into its share, about as many of each.
        rows = placed.withColumn("row", F.xxhash64("id", "v")).select("row", F.explode("places").alias("leaf"), "v").join(sizes, "leaf")
        few = rows.where(F.pmod(F.xxhash64("row", "leaf"), F.greatest(F.lit(1), (F.col("n") / F.lit(OWN)).cast("long"))) == 0)

        def cut(batches: Iterator[pa.RecordBatch], directions: np.ndarray = directions) -> Iterator[pa.RecordBatch]:
            for group in groups(batches, 1):
                x = unit(np.frombuffer(b"".join(r[2] for r in group), kind), dims)
                yield pa.record_batch([pa.array([group[0][0]], pa.int64()), pa.array([own_cuts(x, group[0][1], directions)], pa.list_(pa.float64()))], names=["leaf", "cuts"])

        trees = few.select("leaf", "n", "v").repartition("leaf").sortWithinPartitions("leaf").mapInArrow(cut, "leaf bigint, cuts array<double>")
        trees = scratch.put(trees, f"cuts_{step}")
        parted = trees.where(~F.isnan(F.col("cuts")[0]))
        whole = sizes.select("leaf").join(parted, "leaf", "left_anti")
        final = whole if final is None else final.unionByName(whole)
        if parted.isEmpty():
            return placed

        def lead(batches: Iterator[pa.RecordBatch], directions: np.ndarray = directions) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = unit(np.frombuffer(b"".join(batch.column(2).to_pylist()), kind), dims) if len(batch) else np.zeros((0, dims))
                row, node = own_leaves(x, np.stack(batch.column(3).to_numpy(zero_copy_only=False)) if len(batch) else np.zeros((0, len(directions))), directions)
                old = batch.column(1).to_numpy()[row]
                new = (old.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + node.astype(np.uint64) + np.uint64(step + 1)) >> np.uint64(1)
                yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(old), pa.array(new.astype(np.int64))], names=["row", "old", "new"])

        moved = rows.select("leaf", "row", "v").join(parted, "leaf").select("row", "leaf", "v", "cuts").mapInArrow(lead, "row bigint, old bigint, new bigint")
        moved = moved.groupBy("row").agg(F.collect_set("old").alias("old"), F.collect_set("new").alias("new"))
        both = placed.withColumn("row", F.xxhash64("id", "v")).join(moved, "row", "left")
        places = F.when(F.col("old").isNull(), F.col("places")).otherwise(F.array_sort(F.concat(F.array_except("places", "old"), "new")))
        placed = scratch.put(both.select("id", "many", places.alias("places"), "v"), f"placed_{step}")
    return placed


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
