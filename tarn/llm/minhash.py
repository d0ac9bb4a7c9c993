"""Near-duplicate documents by min-max hashing.

A document is its set of distinct 5-word shingles (64-bit names). Under each permutation both the smallest and the
largest element are kept, so 120 permutations give 240 signature places; each agrees between two sets with a
probability equal to their Jaccard similarity, and the two places of a permutation repel each other slightly, which
lowers the variance. 40 bands of three permutations (six places) make the candidates: two large sets of similarity 0.75
miss every band with probability (1 - 0.75**6) ** 40 = 4e-4, at 0.8 with 5e-6. Small sets agree less often in minimum and
maximum at once; pairs whose smaller set has ``SMALL`` elements or fewer are candidates for certain, since two sets of
similarity s share one of the n - ceil(s n) + 1 smallest elements of each. Candidates are confirmed on the full sets.

Equal sets are collapsed before banding, and links among the rest are found by stars and then between classes only
(see ``_link``), so a group of copies costs tests in proportion to its size.

Defined cases: a text without words, or null, is linked with nothing; a text of fewer than five words is one shingle;
a row with a null id has a null component and is kept; repeated ids share a component; of equal sets the smallest id
leads; very long texts are ordinary; columns besides id and text are ignored, whatever their names; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bits, _vec
from ._link import fetches, groups, link, spanning
from ._store import Scratch

WIDTH, BANDS, PERMS, SHARE, SMALL = 5, 40, 3, 0.75, 16
FLUSH = 4 << 20
_rng = np.random.Generator(np.random.PCG64(77))
MUL = _rng.integers(0, 2**32, BANDS * PERMS, dtype=np.uint32) | np.uint32(1)
ADD = _rng.integers(0, 2**32, BANDS * PERMS, dtype=np.uint32)
FOLD = _rng.integers(0, 2**64, (BANDS, 2 * PERMS), dtype=np.uint64) | np.uint64(1)
SIG = "id bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>"
PIVOTS = pa.schema([("a", pa.int64()), ("salt", pa.int32()), ("role", pa.int32()), ("id", pa.int64()), ("items", pa.binary())])
BLOCKS = pa.schema([("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("block", pa.int32()), ("of", pa.int64()), ("id", pa.int64()), ("items", pa.binary())])


def bands(items: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of band keys for each run of ``items`` that begins at ``first`` (no run is empty)."""
    short = (items >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(first), band, np.uint64)
        for p in range(PERMS):
            h = short * MUL[band * PERMS + p] + ADD[band * PERMS + p]
            key = _vec.mix(key + np.minimum.reduceat(h, first) * FOLD[band, 2 * p])
            key = _vec.mix(key + np.maximum.reduceat(h, first) * FOLD[band, 2 * p + 1])
        out[:, band] = key
    return out


def leads(n: np.ndarray) -> np.ndarray:
    """How many of its smallest elements stand for a set of n, if it can be in a pair with a small one."""
    return np.where(n * SHARE <= SMALL, n - np.ceil(n * SHARE).astype(np.int64) + 1, 0)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _vec.alone()
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, offs in _vec.slices(batch.column(1)):
            h, _, _, bounds = _vec.words(data, offs)
            sets = list(_vec.shingles(h, bounds, WIDTH))
            n = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(n)
            d1, d2 = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
            ends = np.zeros(hi - lo + 1, np.int32)
            flat = np.zeros(0, np.uint64)
            if len(some):
                items = np.concatenate(sets)
                first = (np.cumsum(n) - n)[some]
                d1[some] = np.add.reduceat(_vec.mix(items), first)
                d2[some] = np.add.reduceat(_vec.mix(items ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
                more = leads(n[some])
                at = np.cumsum(more) - more
                own = np.repeat(np.arange(len(some)), more)
                nth = np.arange(len(own)) - at[own]
                keys = np.zeros(len(n), np.int64)
                keys[some] = BANDS + more
                ends[1:] = np.cumsum(keys)
                start = ends[some].astype(np.int64)
                flat = np.empty(ends[-1], np.uint64)
                flat[start[:, None] + np.arange(BANDS)] = bands(items, first)
                flat[start[own] + BANDS + nth] = _vec.mix(items[first[own] + nth] ^ np.uint64(0x5851F42D4C957F2D))
            yield pa.record_batch(
                [
                    ids.slice(lo, hi - lo).cast(pa.int64()),
                    pa.array(n),
                    pa.array(_vec.signed(d1)),
                    pa.array(_vec.signed(d2)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(_vec.signed(flat))),
                ],
                names=["id", "n", "d1", "d2", "bands"],
            )


def _sets(kind: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text, wants) to a row for each want, with the id and the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kind.types, strict=True)], schema=kind)

        for batch in batches:
            for lo, hi, data, offs in _vec.slices(batch.column(1)):
                ids, wants = batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(2).slice(lo, hi - lo).to_pylist()
                h, _, _, bounds = _vec.words(data, offs)
                for key, want, items in zip(ids, wants, _vec.shingles(h, bounds, WIDTH), strict=True):
                    body = items.tobytes()
                    for w in want:
                        out.append((*w.values(), key, body))
                        size += len(body) + 32
                        if size > FLUSH:
                            yield made()
                            out, size = [], 0
        if out:
            yield made()

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two blocks of a bucket at a time: shared elements are counted by products of incidence matrices."""
    for rows in groups(batches, 3):
        sets = [np.frombuffer(r[-1], np.uint64) for r in rows]
        n = np.array([len(x) for x in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        item, owner = flat[order], np.repeat(np.arange(len(sets)), n)[order]
        new = np.concatenate(([True], item[1:] != item[:-1]))
        column = np.cumsum(new) - 1
        many = np.bincount(column) > 1
        rank = np.cumsum(many) - 1
        use = many[column]
        column, owner = rank[column[use]], owner[use]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, int(many.sum()), 8192):
            part = (column >= lo) & (column < lo + 8192)
            m = np.zeros((len(sets), 8192), np.float32)
            m[owner[part], column[part] - lo] = 1
            both += m @ m.T
        of, block = np.array([r[4] for r in rows]), np.array([r[3] for r in rows])
        linked = (both >= SHARE * (n[:, None] + n[None, :] - both)) & (of[:, None] != of[None, :])
        if rows[0][1] != rows[0][2]:
            linked &= block[:, None] != block[None, :]
        pairs = spanning(of, linked)
        yield pa.record_batch([pa.array([rows[p[k]][5] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted so that a group's pivot leads: only that one set is held. Yields the links."""
    group, pivot = None, None
    for batch in batches:
        a, b = [], []
        for x, salt, role, key, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            items = np.frombuffer(body, np.uint64)
            if role == 0:
                group, pivot = (x, salt), items
                continue
            if group != (x, salt) or not len(pivot) or not len(items):
                continue
            at = np.searchsorted(pivot, items)
            both = int((pivot[np.minimum(at, len(pivot) - 1)] == items).sum())
            if both >= SHARE * (len(pivot) + len(items) - both):
                a.append(x)
                b.append(key)
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = scratch.put(rows.mapInArrow(_signatures, SIG), "sig")
    usable = sig.where("n > 0 and id is not null")
    sets = scratch.put(usable.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep")), "sets")
    lead = usable.join(sets.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id", "d1", "d2"])
    placed = lead.select("id", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x != y").select("key")
    members = scratch.put(placed.join(shared, "key"), "members")

    body = scratch.put(_bits.rows_of(rows, scratch.put(members.select("id").distinct(), "wanted")), "body")

    def star(pairs: DataFrame) -> DataFrame:
        held = body.join(fetches(pairs), "id").select("id", "text", "wants").mapInArrow(_sets(PIVOTS), "a bigint, salt int, role int, id bigint, items binary")
        held = held.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
        return held.mapInArrow(_confirm, "a bigint, b bigint").distinct()

    def blocks(wants: DataFrame) -> DataFrame:
        held = body.join(wants, "id").select("id", "text", "wants").mapInArrow(_sets(BLOCKS), "key bigint, lo int, hi int, block int, of bigint, id bigint, items binary")
        held = held.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
        return held.mapInArrow(_compare, "a bigint, b bigint").distinct()

    classes = link(members, star, blocks, scratch)
    scratch.drop("members", "links", "wanted", "body")
    of = sets.join(classes, F.col("rep") == F.col("node"), "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("low"))
    out = sig.where("n > 0").join(of, ["d1", "d2", "n"], "left").select("id", "n", "low")
    out = out.unionByName(sig.where("n = 0").select("id", "n", F.lit(None).cast("bigint").alias("low")))
    own = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("low", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).withColumnRenamed("id", "doc_id")
