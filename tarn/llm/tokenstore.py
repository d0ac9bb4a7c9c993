"""Token ids in a content-addressed store.

Every text is encoded with the tokenizers library, an end id is appended, and the id stream is cut where a rolling
hash over the last 8 ids says so (about 1,024 ids a chunk, 128 at least, 8,192 at most; edits move only the cuts near
them). A chunk is named by the SHA-256 of its ids as little-endian unsigned integers and stored once, whatever the
number of documents that hold it. The format is three Parquet tables in one folder:

* ``chunks``: name, number of ids, ids (zstd over little-endian integers of 2 or 4 bytes, as the vocabulary needs);
* ``recipes``: root, and the names of a document's chunks in order; documents of equal ids share one recipe;
* ``documents``: in ascending id order: doc_id, segment, start (ids of all documents before it), number of ids, root.

A document's root is the Merkle root over its chunk names; ``manifest`` holds each segment's root over its documents'
roots, so that any part can be verified alone. Reading back decodes every chunk, names it anew from its ids, derives
lengths, checksums (CRC-32s of chunks combine) and roots from what was read, and holds the segments' roots against the
manifest.

Texts of byte-level models are cut where their pre-tokenizer always cuts. Each piece is encoded by the library once and
then known by a 64-bit hash of its characters; texts that hold an added token (or have 2**20 characters or more) go to the library whole.

Defined cases: null text is empty (the end id alone); equal ids order by root; rows with a null id come first; repeated
rows are documents of their own; a vocabulary that doesn't fit ``width`` is an error; an empty table gives an empty
store; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _vec
from ._memo import Table, names_of
from ._store import Scratch

MEAN_BITS, LEAST, MOST, SPAN = 10, 128, 8192, 8
MEMO, GIVEN = 1_000_000, 200_000
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(4242))
GEAR = _rng.integers(0, 2**64, 1 << 16, dtype=np.uint64)
#: White space as the pre-tokenizer sees it.
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Classes of characters: what is clearly a letter (in every Unicode version), a digit of ASCII or a mark of ASCII; the rest is unclear.
UNCLEAR, SPACE, ALPHA, DIGIT, PUNCT = range(5)
CLASS = np.zeros(0x3002, np.uint8)
CLASS[33:127] = PUNCT
for _lo, _hi in ((65, 91), (97, 123), (0xC0, 0xD7), (0xD8, 0xF7), (0xF8, 0x250)):
    CLASS[_lo:_hi] = ALPHA
CLASS[48:58] = DIGIT
CLASS[SPACES] = SPACE
#: Whether the pre-tokenizer always cuts between two characters that aren't white space, by class: what is unclear stays with its neighbours.
APART = np.zeros(25, bool)
for _one in (ALPHA, DIGIT, PUNCT):
    for _two in (ALPHA, DIGIT, PUNCT):
        APART[5 * _one + _two] = _one != _two
#: A run of letters, digits or marks, with at most one space before it, and the characters that byte-level models show bytes as.
WORD = re.compile(" ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+|[!-/:-@\\[-`{-~]+)")
_shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTER = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _shown)}


def piece_starts(cps: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Places where a piece begins: a subset of the places where the pre-tokenizer cuts. offs: where documents begin, and the end.

    It cuts before white space, before the last white space of a run (if something follows), after white space that is
    no space, and between letters, digits and marks, but that an apostrophe may go with the letters after it.
    """
    n = len(cps)
    c = CLASS[np.minimum(cps, 0x3001)]
    space = c == SPACE
    cut = np.empty(n, bool)
    cut[1:] = APART[5 * c[:-1] + c[1:]] & ((cps[:-1] != 39) | (c[1:] == PUNCT))
    cut[1:] |= space[1:] & ~space[:-1]
    cut[1:] |= space[:-1] & ~space[1:] & (cps[:-1] != 32)
    first = offs[:-1][offs[:-1] < offs[1:]]
    ends = np.zeros(n + 1, bool)
    ends[first], ends[n] = True, True
    last = space & ~ends[1:]  # the last white space of a run that something follows
    last[:-1] &= ~space[1:]
    cut[1:] |= last[1:] & space[:-1]
    cut[first] = True
    return np.flatnonzero(cut)


class Encoder:
    """The library's ids of texts. A piece is encoded by the library when it is new; a bounded memo keeps its ids."""

    def __init__(self, path: str, end: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = parts = Tokenizer.from_file(path)
        self.end = end
        #: Texts that hold one of these go to the library as they are.
        self.added = [t.content for t in parts.get_added_tokens_decoder().values()]
        pre = parts.pre_tokenizer
        #: Whether texts may be cut into pieces, and the model sees just the bytes of a word.
        self.plain = parts.normalizer is None and type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and getattr(pre, "use_regex", True) and type(parts.model).__name__ == "BPE"
        self.model = parts.model
        self.memo = Table(MEMO, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, self.end], np.uint32)

    def make(self, piece: str) -> list[int]:
        """Letters, digits or marks alone are one word to the pre-tokenizer, which goes to the library's model directly."""
        if WORD.fullmatch(piece):
            shown = piece.replace(" ", "\u0120") if piece.isascii() else piece.encode().decode("latin-1").translate(LETTER)
            return [t.id for t in self.model.tokenize(shown)]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, each with the end id, and where each text's begin (one more at the end)."""
        special = [not self.plain or len(t) >= 1 << 20 or any(map(t.__contains__, self.added)) for t in texts]
        text = "".join("" if s else t for t, s in zip(texts, special, strict=True))
        offs = np.concatenate(([0], np.cumsum([0 if s else len(t) for t, s in zip(texts, special, strict=True)]))).astype(np.int64)
        if not text:
            flat, counts = np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        else:
            cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            start = piece_starts(cps, offs)
            name, size = names_of(cps, start)
            pieces = lambda new: map(text.__getitem__, map(slice, start[new].tolist(), (start + size)[new].tolist()))
            flat, stop = self.memo.gather(self.memo.places(name, lambda new: [self.make(piece) for piece in pieces(new)]))
            counts = np.diff(np.concatenate(([0], stop))[np.searchsorted(start, offs)])
        parts, at = [], 0
        if any(special):
            for t, s, n in zip(texts, special, counts.tolist(), strict=True):
                parts.append(self.whole(t) if s else np.append(flat[at : at + n], np.uint32(self.end)))
                at += n
            return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        bounds = np.concatenate(([0], np.cumsum(counts + 1)))
        out = np.full(bounds[-1], self.end, np.uint32)
        keep = np.ones(len(out), bool)
        keep[bounds[1:] - 1] = False
        out[keep] = flat
        return out, bounds


@functools.lru_cache(2)
def encoder(path: str, end: int) -> Encoder:
    """One for each worker process, kept between tasks."""
    return Encoder(path, end)


_vec.MEMOS.append(encoder.cache_clear)


def cuts(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each id stream [bounds[k], bounds[k + 1]), as places in ``ids``."""
    n = len(ids)
    g = GEAR[ids & np.uint32(0xFFFF)]
    h = np.zeros(n, np.uint64)
    for k in range(min(SPAN, n)):
        h[SPAN - 1 :] += g[SPAN - 1 - k : n - k] << U(k * 5)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    # The first places of a stream see the one before it, but no chunk is so short.
    may = np.flatnonzero(h >> U(64 - MEAN_BITS) == 0) + 1
    within, may = np.searchsorted(may, bounds).tolist(), may.tolist()
    out = []
    for k, (last, end) in enumerate(itertools.pairwise(bounds.tolist())):
        mine = []
        for c in may[within[k] : within[k + 1]]:
            while c - last > MOST:
                last += MOST
                mine.append(last)
            if c - last >= LEAST and end - c >= LEAST // 2:
                mine.append(c)
                last = c
        while end - last > MOST:
            last += MOST
            mine.append(last)
        out.append([*mine, end])
    return out


def merkle(names: list[bytes]) -> bytes:
    """Root over names in order; a level's odd last one moves up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in names] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[k] + level[k + 1]).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def crc_combine(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of joined strings from those of the parts; ``size``: bytes of the second parts."""
    out = first.astype(np.uint32).copy()
    for bit, columns in enumerate(_shifts()):
        on = (size >> bit & 1).astype(bool)
        if on.any():
            x, y = out[on], np.zeros(int(on.sum()), np.uint32)
            for k in range(32):
                y ^= np.where(x >> np.uint32(k) & np.uint32(1), columns[k], np.uint32(0))
            out[on] = y
    return out ^ second.astype(np.uint32)


@functools.lru_cache(1)
def _shifts() -> list[np.ndarray]:
    """For each power of two, the matrix (by columns) that appends so many zero bytes to a CRC-32 register."""
    one = np.array([(1 << k) >> 1 if k else 0xEDB88320 for k in range(32)], np.uint32)  # a zero bit
    apply = lambda m, x: np.bitwise_xor.reduce(m[[k for k in range(32) if x >> k & 1]]) if x else np.uint32(0)
    square = lambda m: np.array([apply(m, int(c)) for c in m], np.uint32)
    m = square(square(square(one)))
    out = [m]
    for _ in range(39):
        out.append(square(out[-1]))
    return out


def write(docs: DataFrame, folder: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> None:
    """Encode ``docs`` with the tokenizer file at path ``tokenizer`` (it must be at that path on every executor)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    kind = np.uint16 if width == 2 else np.uint32

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, pack = encoder(tokenizer, end), zstandard.ZstdCompressor(level=1)
        if width == 2 and max(machine.tokenizer.get_vocab_size(), end + 1) > 1 << 16:
            raise ValueError("ids of this vocabulary take more than two bytes")
        given: set[bytes] = set()
        fields = pa.struct([("name", pa.binary()), ("n", pa.int32()), ("ids", pa.binary())])
        for batch in batches:
            for lo, hi, _, _ in _vec.slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                ids, bounds = machine.ids([t or "" for t in part.column(1).to_pylist()])
                body, small = memoryview(ids).cast("B"), memoryview(ids.astype(kind)).cast("B")
                roots, recipes, fresh = [], [], []
                for a, ends in zip(bounds.tolist(), cuts(ids, bounds), strict=False):
                    names, new = [], []
                    for b in ends:
                        name = hashlib.sha256(body[4 * a : 4 * b]).digest()
                        names.append(name)
                        if name not in given:
                            given.add(name)
                            new.append({"name": name, "n": b - a, "ids": pack.compress(small[width * a : width * b])})
                        a = b
                    roots.append(merkle(names))
                    recipes.append(names)
                    fresh.append(new)
                if len(given) > GIVEN:  # what is given out again is found equal later
                    given.clear()
                yield pa.record_batch(
                    [part.column(0).cast(pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(roots, pa.binary()), pa.array(recipes, pa.list_(pa.binary())), pa.array(fresh, pa.list_(fields))],
                    names=["doc_id", "n_tokens", "root", "names", "fresh"],
                )

    staged = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        encode, "doc_id bigint, n_tokens bigint, root binary, names array<binary>, fresh array<struct<name:binary,n:int,ids:binary>>"
    )
    staged = scratch.put(staged, "staged")
    # One copy of each chunk: rows of a name meet in one task in order, the first one stays.
    fresh = staged.select(F.explode("fresh").alias("c")).select("c.*").repartition("name").sortWithinPartitions("name")
    fresh.mapInArrow(_once, "name binary, n int, ids binary").write.mode("overwrite").parquet(f"{folder}/chunks")
    staged.select("root", "names").dropDuplicates(["root"]).write.mode("overwrite").parquet(f"{folder}/recipes")
    placed = staged.select("doc_id", "n_tokens", "root").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    placed = scratch.put(placed.withColumn("segment", F.spark_partition_id()), "placed")
    # A row for each segment, of which there are as many as partitions: the running total is taken over those.
    totals = placed.groupBy("segment").agg(F.sum("n_tokens").alias("n")).collect()
    base, bases = 0, []
    for row in sorted(totals, key=lambda r: r["segment"]):
        bases.append((row["segment"], base))
        base += row["n"]
    bases = spark.createDataFrame(bases, "segment int, base bigint")
    before = Window.partitionBy("segment").orderBy(F.col("doc_id").asc_nulls_first(), "root").rowsBetween(Window.unboundedPreceding, -1)
    located = placed.join(F.broadcast(bases), "segment").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    located.select("doc_id", "segment", "start", "n_tokens", "root").write.mode("overwrite").parquet(f"{folder}/documents")
    _segments(spark.read.parquet(f"{folder}/documents")).write.mode("overwrite").parquet(f"{folder}/manifest")
    scratch.drop("staged", "placed")


def _segments(documents: DataFrame) -> DataFrame:
    """(segment, n_documents, root) of each segment of the documents' table."""
    rows = documents.select("segment", "start", "root").repartition("segment").sortWithinPartitions("segment", "start")
    return rows.mapInArrow(_segment_roots, "segment int, n_documents bigint, root binary")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for batch in batches:
        names = batch.column(0).to_pylist()
        keep = [x != y for x, y in zip(names, [last, *names[:-1]], strict=True)]
        last = names[-1] if names else last
        yield batch.filter(pa.array(keep, pa.bool_()))


def _segment_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Roots over the documents' roots of each segment, by start; only the open levels of the tree are held."""
    segment, n, levels, out = None, 0, {}, []

    def close() -> None:
        done = None
        for level in sorted(levels):
            done = levels[level] if done is None else hashlib.sha256(b"\1" + levels[level] + done).digest()
        out.append((segment, n, done))

    for batch in batches:
        for s, _, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s != segment:
                if segment is not None:
                    close()
                segment, n, levels = s, 0, {}
            n, level, node = n + 1, 0, hashlib.sha256(b"\0" + root).digest()
            while level in levels:
                node = hashlib.sha256(b"\1" + levels.pop(level) + node).digest()
                level += 1
            levels[level] = node
    if segment is not None:
        close()
    yield pa.record_batch([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["segment", "n_documents", "root"])


def _measure(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Chunks to (name, length, checksum) as their ids say."""
    for batch in batches:
        rows = []
        for ids in batch.column(0).to_pylist():
            body = ids_of_chunk(ids, width).tobytes()
            rows.append((hashlib.sha256(body).digest(), len(body) // 4, zlib.crc32(body)))
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64()))], names=["name", "n", "crc"])


def ids_of_chunk(stored: bytes, width: int = 2) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(stored), np.uint16 if width == 2 else np.uint32).astype("<u4")


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, parts in order) to (root, length, checksum, whether the root is that of the parts read)."""
    for batch in batches:
        roots, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        crc, n = np.zeros(len(roots), np.uint32), np.zeros(len(roots), np.int64)
        for k in range(max(map(len, parts), default=0)):
            at = np.array([i for i, p in enumerate(parts) if len(p) > k])
            size = np.array([parts[i][k]["n"] for i in at])
            crc[at] = crc_combine(crc[at], np.array([parts[i][k]["crc"] for i in at], np.uint32), size * 4)
            n[at] += size
        good = [merkle([x["name"] for x in p]) == r for r, p in zip(roots, parts, strict=True)]
        yield pa.record_batch([batch.column(0), pa.array(n), pa.array(crc.astype(np.int64)), pa.array(good)], names=["root", "n", "crc", "verified"])


def read_back(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, verified) from the files alone; no ids are shuffled."""
    chunks = spark.read.parquet(f"{folder}/chunks").select("ids").mapInArrow(lambda b: _measure(b, width), "name binary, n bigint, crc bigint")
    steps = spark.read.parquet(f"{folder}/recipes").select("root", F.posexplode("names").alias("place", "name"))
    parts = steps.join(chunks, "name").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("place", "name", "n", "crc"))).alias("parts"))
    known = parts.mapInArrow(_recipes, "root binary, n bigint, crc bigint, verified boolean")
    docs = spark.read.parquet(f"{folder}/documents")
    # A segment's root, made anew from its documents' roots, has to be the manifest's; there are as many as partitions.
    again = _segments(docs).withColumnsRenamed({"root": "found", "n_documents": "has"})
    segments = again.join(F.broadcast(spark.read.parquet(f"{folder}/manifest")), "segment", "left")
    whole = segments.select("segment", F.coalesce((F.col("found") == F.col("root")) & (F.col("has") == F.col("n_documents")), F.lit(False)).alias("whole"))
    out = docs.join(known, "root", "left").join(F.broadcast(whole), "segment")
    good = F.coalesce(F.col("verified") & (F.col("n") == F.col("n_tokens")), F.lit(False)) & F.col("whole")
    return out.select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"), good.alias("verified"))


def read_ids(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """(doc_id, start, ids): every document's ids, put together from its chunks."""
    steps = spark.read.parquet(f"{folder}/documents").join(spark.read.parquet(f"{folder}/recipes"), "root").select("doc_id", "start", F.posexplode("names").alias("place", "name"))
    held = steps.join(spark.read.parquet(f"{folder}/chunks"), "name").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("place", "ids"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([ids_of_chunk(p["ids"], width) for p in parts]).tolist() for parts in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return held.mapInArrow(join, "doc_id bigint, start bigint, ids array<bigint>")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids, from the files just written."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = Scratch(spark, "op10").path("store")
    write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return read_back(spark, folder)
