"""Toxicity by class-conditional Kneser-Ney models.

Two models of words, one of toxic and one of ordinary text, spell a word symbol by symbol: each symbol's probability
follows from what has been spelt of the word so far. Counts of what followed a beginning are kept by class and
discounted; what a beginning withholds goes to one distribution that both classes share, made of continuation counts
(in how many different beginnings a symbol followed the two before it). A rare expression that neither class knows is
thus spelt alike under both, while a stem that one class uses weighs in all its forms. The larger class's counts are
scaled to the other's, since else it would withhold less for the same novelty. A document's figures are its
log-likelihood ratio by word, the largest of a word, and what its words have beyond two levels, each normalised by the
number of words and by its root; a logistic curve turns them into a score.

Words are runs of letters and digits, read to their end; more than ``LONG`` bytes are spelt in pieces of that length. In
scripts without spaces each character begins a word, of itself and the two after it.

Counts come from every labelled row but those of fold 2 (held out) and at most ``CURVE_ROWS`` of fold 3, on which the
curve is fitted. The vocabularies of the labelled and of the scored rows are tables that grow with the text; each
distinct word is spelt once. Words are sorted over the cluster for that, so that a block of neighbours holds the counts
of its beginnings (``ratios``). Of the scored words the most frequent, ``MOST_KNOWN`` at most, are broadcast with their
ratios; all others are joined.

Defined cases: null and empty texts get the score of a text without evidence, as any text of
unknown words; without labels of both classes every score is 0; labels of a row that disagree count as toxic, a label
that is neither 0 nor 1 as ordinary; rows with a null label aren't learnt from; repeated rows are rows of their own; columns besides key and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec
from ._labels import fold, with_text
from ._store import Scratch

LONG, BLOCK, MOST_KNOWN, CURVE_ROWS, CUT = 32, 25_000, 1 << 18, 6000, 0.3
#: Counts that the shared distribution adds to every beginning, and the log ratios from which a word counts as strong.
PRIOR, STRONG, FIGURES = 10.0, (1.5, 4.0), 6
U = np.uint64
#: The name of the empty beginning.
ROOT = U(1)


def _symbols(data: np.ndarray) -> np.ndarray:
    """Case folded, digits alike, white space alike."""
    table = _vec.LOWER.copy()
    table[48:58] = 48
    table[[9, 10, 11, 12, 13]] = 32
    return table[data]


class Nodes:
    """The beginnings of words: a row for each byte, in the order of the words."""

    def __init__(self, s: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        size = ends - starts
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(first, size)
        self.first, self.size, self.place = first, size, place
        sym = s[np.repeat(starts, size) + place]
        run = np.cumsum(_vec.BYTE[sym] * _vec.PLACE[place], dtype=np.uint64)
        run -= np.concatenate((run[:1] * U(0), run))[np.repeat(first, size)]
        self.key = _vec.mix(run + (place + 1).astype(np.uint64))
        self.parent = np.where(place > 0, np.roll(self.key, 1), ROOT)
        back = lambda k: np.where(place >= k, np.roll(sym, k), 0).astype(np.uint64)
        self.tri = sym.astype(np.uint64) | back(1) << U(8) | back(2) << U(16)
        #: The words' names, as ``_vec.words`` gives them.
        self.name = _vec.mix(run[first + size - 1] + size.astype(np.uint64) * U(0x9E3779B97F4A7C15))


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Symbols of a slice, its words' hashes, starts and ends, and where each document's words begin.

    In scripts without spaces each character begins a word, of itself and the two after it.
    """
    s = _symbols(data)
    at = _vec.unspaced(s)
    if not len(at):
        return s, *_short(s, *_vec.words(s, offs, _vec.ALNUM, fold=False), offs)
    stop = at + np.where(s[at] >= 0xF0, 4, 3)
    other = s.copy()
    for k in range(4):
        other[(at + k)[at + k < stop]] = 32
    h, starts, ends, _ = _vec.words(other, offs, _vec.ALNUM, fold=False)
    doc = np.searchsorted(offs, at, "right")
    end = stop.copy()
    for _ in range(2):
        on = np.flatnonzero((stop[:-1] == at[1:]) & (doc[:-1] == doc[1:]))
        new = stop.copy()
        new[on] = end[on + 1]
        end = new
    size, mine = end - at, np.zeros(len(at), np.uint64)
    for k in range(int(size.max())):
        on = size > k
        mine[on] += _vec.BYTE[s[at[on] + k]] * _vec.PLACE[k]
    h = np.concatenate((h, _vec.mix(mine + size.astype(np.uint64) * U(0x9E3779B97F4A7C15))))
    starts, ends = np.concatenate((starts, at)), np.concatenate((ends, end))
    order = np.argsort(starts, kind="stable")
    return s, *_short(s, h[order], starts[order], ends[order], np.searchsorted(starts[order], offs), offs)


def _short(s: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words of more than ``LONG`` bytes in pieces of that length, the last one of what is left."""
    if not len(h) or (ends - starts).max() <= LONG:
        return h, starts, ends, bounds
    pieces = -(-(ends - starts) // LONG)
    which = np.repeat(np.arange(len(h)), pieces)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lo = starts[which] + nth * LONG
    hi = np.minimum(lo + LONG, ends[which])
    name = h[which]
    cut = np.flatnonzero(pieces[which] > 1)
    name[cut] = Nodes(s, lo[cut], hi[cut]).name
    return name, lo, hi, np.searchsorted(lo, offs)


def _binary(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs [start, end) of bytes as one binary column."""
    size = ends - starts
    stop = np.cumsum(size)
    body = s[np.repeat(starts - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], stop)).astype(np.int32)), pa.py_buffer(body)])


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as (bytes, sizes)."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    body = words.buffers()[2]
    return (np.frombuffer(body, np.uint8)[ends[0] : ends[-1]] if body is not None else np.zeros(0, np.uint8)), np.diff(ends)


VOCABULARY = "word binary, o bigint, t bigint, n bigint"


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, mark) to how often each word occurs in rows of mark 0 (o), 1 (t) and -1 (n), summed within the task."""
    _vec.alone()
    held: list[tuple] = []
    size = 0

    def merged() -> tuple:
        h = np.concatenate([x[0] for x in held])
        h, at, inv = np.unique(h, return_index=True, return_inverse=True)
        return h, pa.concat_arrays([x[1] for x in held]).take(pa.array(at)), *(np.bincount(inv, np.concatenate([x[k] for x in held]), len(h)).astype(np.int64) for k in (2, 3, 4))

    rows = lambda x: pa.record_batch([x[1], *map(pa.array, x[2:])], names=["word", "o", "t", "n"])
    for batch in batches:
        marks = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int64)
        for lo, hi, data, offs in _vec.slices(batch.column(0)):
            s, h, starts, ends, bounds = _words(data, offs)
            if not len(h):
                continue
            names, at, inv = np.unique(h, return_index=True, return_inverse=True)
            mark = np.repeat(marks[lo:hi], np.diff(bounds))
            held.append((names, _binary(s, starts[at], ends[at]), *(np.bincount(inv, mark == m, len(names)).astype(np.int64) for m in (0, 1, -1))))
            size += len(names)
            if size > 400_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 250_000:
                    yield rows(held[0])
                    held, size = [], 0
    if held:
        yield rows(merged())


BLOCKS = "words binary, sizes array<int>, o array<bigint>, t array<bigint>, n array<bigint>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a vocabulary in the order of their words to a row for each run of about ``BLOCK`` distinct words."""

    def made(rows: pa.Table) -> pa.RecordBatch:
        body, sizes = _bytes(rows["word"].combine_chunks())
        lists = [pa.array([x], kind) for x, kind in ((sizes.astype(np.int32), pa.list_(pa.int32())), *((rows[c].to_numpy(), pa.list_(pa.int64())) for c in "otn"))]
        return pa.record_batch([pa.array([body.tobytes()], pa.binary()), *lists], names=["words", "sizes", "o", "t", "n"])

    def merge(rows: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(rows).combine_chunks()
        word = table["word"].combine_chunks()
        new = np.append(True, pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)) if len(word) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        return pa.table({"word": word.take(pa.array(first)), **{c: np.add.reduceat(table[c].to_numpy(), first) if len(first) else table[c] for c in "otn"}})

    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(map(len, held)) > 2 * BLOCK:
            rows = merge(held)
            while len(rows) > BLOCK:  # the last word may go on in the next batch
                yield made(rows.slice(0, BLOCK))
                rows = rows.slice(BLOCK)
            held = [rows]
    if held and len(rows := merge(held)):
        yield made(rows)


def _by_key(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    uniq, inv = np.unique(keys, return_inverse=True)
    return uniq, *(np.bincount(inv, v, len(uniq)) for v in values)


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def shared(pair: np.ndarray, n3: np.ndarray) -> np.ndarray:
    """The shared distribution at each symbol with the two before it (``pair``, sorted), from in how many beginnings it ends."""
    head, total3, kinds3 = _by_key(pair >> U(8), n3, np.ones(len(pair)))
    low, n2 = _by_key(pair & U(0xFFFF), np.ones(len(pair)))
    head2, total2, kinds2 = _by_key(low >> U(8), n2, np.ones(len(low)))
    d, p, ctx = 0.75, pair & U(0xFFFF), pair >> U(8)
    total = _at(head2, total2, p >> U(8), 0)
    shared2 = (np.maximum(_at(low, n2, p, 0) - d, 0) + d * _at(head2, kinds2, p >> U(8), 0) / 256 + 1 / 256) / (total + 1)
    return (np.maximum(n3 - d, 0) + (d * _at(head, kinds3, ctx, 0) + 1) * shared2) / (_at(head, total3, ctx, 0) + 1)


class Trie:
    """The beginnings of a block's words, and their counts in the labelled words of the block.

    Blocks hold runs of the sorted words, so that only beginnings of a block's first or last word can have counts
    elsewhere; ``edge`` marks them.
    """

    def __init__(self, words: bytes, sizes: np.ndarray, o: np.ndarray, t: np.ndarray):
        s, ends = np.frombuffer(words, np.uint8), np.cumsum(sizes)
        self.nodes = nodes = Nodes(s, ends - sizes, ends)
        self.key, at, self.inv = np.unique(nodes.key, return_index=True, return_inverse=True)
        self.parent, self.tri = nodes.parent[at], nodes.tri[at]
        self.counts = np.stack([np.bincount(self.inv, np.repeat(x, sizes), len(self.key)) for x in (o, t)])
        edges = np.concatenate((nodes.key[: sizes[0]], nodes.key[nodes.first[-1] :], [ROOT]))
        self.edge, self.under_edge = np.isin(self.key, edges), np.isin(self.parent, edges)

    def families(self, use: np.ndarray, scale: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
        """Parents of the beginnings ``use``, and of each class the sum of their counts and what is withheld of them."""
        c = self.counts[:, use] * scale[:, None]
        parent, inv = np.unique(self.parent[use], return_inverse=True)
        return parent, np.stack([np.bincount(inv, x, len(parent)) for x in (*c, *np.minimum(c, discount))])


@dataclass
class Whole:
    """What a block can't know by itself: class scales and the discount, the shared distribution, and beginnings that blocks share."""

    scale: np.ndarray
    discount: float
    tri: np.ndarray
    below: np.ndarray
    key: np.ndarray
    counts: np.ndarray
    parent: np.ndarray
    sums: np.ndarray


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for row in range(len(batch)):
            words, *lists = (c[row] for c in batch.columns)
            yield words.as_py(), *(x.values.to_numpy() for x in lists)


def _survey(blocks: DataFrame, scale: np.ndarray, discount: float) -> Whole:
    """Three kinds of rows reach the driver: a number for each three symbols in a row (0), and for each block the
    beginnings of two words: their counts (1) and what is known of their children (2). None of them grows with the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, sizes, o, t, _ in _blocks_of(batches):
            x = Trie(words, sizes, o, t)
            known = x.counts.sum(0) > 0
            tri, n = np.unique(x.tri[known & ~x.edge], return_counts=True)
            edge = np.flatnonzero(known & x.edge)
            parent, sums = x.families(known & ~x.edge & x.under_edge, scale, discount)
            zero = lambda k: np.zeros(k, np.uint64)
            kinds = [(tri, zero(len(tri)), zero(len(tri)), np.stack([n.astype(float), *[np.zeros(len(n))] * 3])), (x.key[edge], x.parent[edge], x.tri[edge], np.concatenate((x.counts[:, edge], np.zeros((2, len(edge)))))), (parent, zero(len(parent)), zero(len(parent)), sums)]
            for k, (*names, values) in enumerate(kinds):
                yield pa.record_batch([pa.array(np.full(len(names[0]), k, np.int32)), *(pa.array(_vec.signed(c)) for c in names), *(pa.array(v) for v in values)], names=["kind", "key", "parent", "tri", "v0", "v1", "v2", "v3"])

    found = blocks.mapInArrow(run, "kind int, key bigint, parent bigint, tri bigint, v0 double, v1 double, v2 double, v3 double")
    found = found.groupBy("kind", "key").agg(F.min("parent").alias("parent"), F.min("tri").alias("tri"), *(F.sum(f"v{k}").alias(f"v{k}") for k in range(4)))
    got = found.toArrow().to_pandas()
    whole = lambda k, c: got.loc[got["kind"] == k, c].to_numpy().astype(np.int64).view(np.uint64)
    values = lambda k: got.loc[got["kind"] == k, ["v0", "v1", "v2", "v3"]].to_numpy(float).T
    tri, n = _by_key(np.concatenate((whole(0, "key"), whole(1, "tri"))), np.concatenate((values(0)[0], np.ones(len(whole(1, "key"))))))
    key, counts = whole(1, "key"), values(1)[:2]
    order = np.argsort(key)
    c = counts * scale[:, None]
    parents = np.concatenate((whole(2, "key"), whole(1, "parent")))
    parent, *sums = _by_key(parents, *np.concatenate((values(2), np.concatenate((c, np.minimum(c, discount)))), axis=1))
    return Whole(scale, discount, tri, shared(tri, n), key[order], counts[:, order], parent, np.stack(sums))


def _word_ratios(x: Trie, all_: Whole) -> np.ndarray:
    """The log ratio of each word of a block: the sum over its beginnings."""
    at = np.minimum(np.searchsorted(all_.key, x.key), max(len(all_.key) - 1, 0))
    if len(all_.key):
        same = all_.key[at] == x.key
        x.counts[:, same] = all_.counts[:, at[same]]
    known = x.counts.sum(0) > 0
    parent, sums = x.families(known, all_.scale, all_.discount)
    # Stand-ins for what has no known child: nothing counted, nothing withheld.
    family = np.zeros((4, len(x.key)))
    for names, values in ((parent, sums), (all_.parent, all_.sums)):
        if len(names):
            at = np.minimum(np.searchsorted(names, x.parent), len(names) - 1)
            same = names[at] == x.parent
            family[:, same] = values[:, at[same]]
    left = (family[2:] + PRIOR) / (family[:2] + PRIOR)
    logs = np.log(left[1] / left[0])
    c = x.counts[:, known] * all_.scale[:, None]
    below = _at(all_.tri, all_.below, x.tri[known], 0.0)
    probs = np.maximum(c - all_.discount, 0) / (family[:2, known] + PRIOR) + left[:, known] * below
    logs[known] = np.log(probs[1] / probs[0])
    return np.add.reduceat(logs[x.inv], x.nodes.first)


def ratios(vocabulary: DataFrame, scratch: Scratch) -> DataFrame:
    """(w, r, n): the name, log ratio and number of occurrences of every word of ``vocabulary`` (word, o, t, n) that has any.

    The words are sorted over the cluster and packed into blocks: each block finds the counts of nearly all beginnings
    of its words in itself, and no group of words, however alike, is too large for a task.
    """
    rows = vocabulary.repartitionByRange("word").sortWithinPartitions("word")
    blocks = scratch.put(rows.mapInArrow(_blocks, BLOCKS), "blocks")
    added = lambda x: F.sum(F.aggregate(x, F.lit(0).cast("bigint"), lambda a, y: a + y))
    with_count = lambda c, k: F.sum(F.size(F.filter(c, lambda x: x == k)))
    stats = [added(F.zip_with("sizes", c, lambda s, x: s * x)) for c in "ot"] + [with_count(c, k) for c in "ot" for k in (1, 2)]
    o, t, *few = (float(x or 0) for x in blocks.agg(*stats).first())
    ones, twos = few[:2] if o <= t else few[2:]
    scale = np.array([min(1.0, min(o, t) / max(x, 1.0)) for x in (o, t)])
    all_ = blocks.sparkSession.sparkContext.broadcast(_survey(blocks, scale, ones / (ones + 2 * twos) if ones else 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, sizes, o, t, n in _blocks_of(batches):
            if n.any():
                x = Trie(words, sizes, o, t)
                r, asked = _word_ratios(x, all_.value), np.flatnonzero(n)
                yield pa.record_batch([pa.array(_vec.signed(x.nodes.name[asked])), pa.array(r[asked]), pa.array(n[asked])], names=["w", "r", "n"])

    out = scratch.put(blocks.mapInArrow(run, "w bigint, r double, n bigint"), "words")
    scratch.drop("blocks")
    return out


class Table:
    """uint64 keys to values, open addressing, all keys placed."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(len(keys)).bit_length() + 1)
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, np.nan)
        rest, probe = np.arange(len(keys)), 0
        while len(rest):
            slot = self._slot(keys[rest], probe)
            free = np.flatnonzero(np.isnan(self.values[slot]))
            taken, first = np.unique(slot[free], return_index=True)
            at = free[first]
            self.keys[taken], self.values[taken] = keys[rest[at]], values[rest[at]]
            rest = np.delete(rest, at)
            probe += 1
        self.probes = probe

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return (_vec.mix(keys + U(probe)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none), and whether there is one."""
        out, hit = np.zeros(len(keys)), np.zeros(len(keys), bool)
        rest = np.arange(len(keys))
        for probe in range(self.probes):
            slot = self._slot(keys[rest], probe)
            value, same = self.values[slot], self.keys[slot] == keys[rest]
            some = ~np.isnan(value)
            got = rest[same & some]
            out[got], hit[got] = value[same & some], True
            rest = rest[~same & some]
            if not len(rest):
                break
        return out, hit


SUMS = ["n", "s", "m", "c0", "c1"]
OPEN = pa.struct([("w", pa.int64()), ("times", pa.int32())])


def _sums(table: Table, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Of each document of a slice: number of words, sum, maximum and what is beyond ``STRONG`` of the words in ``table``; the others."""
    out, n = np.zeros((len(offs) - 1, len(SUMS))), len(offs) - 1
    out[:, 2] = -np.inf
    s, h, starts, ends, bounds = _words(data, offs)
    if not len(h):
        return out, pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], OPEN))
    names, inv = np.unique(h, return_inverse=True)
    ratio, found = table.find(names)
    word, shut = ratio[inv], found[inv]
    out[:, 0] = np.diff(bounds)
    some = np.flatnonzero(out[:, 0])
    first = bounds[:-1][some]
    out[some, 1] = np.add.reduceat(np.where(shut, word, 0), first)
    out[some, 2] = np.maximum.reduceat(np.where(shut, word, -np.inf), first)
    for k, least in enumerate(STRONG):
        out[some, 3 + k] = np.add.reduceat(np.where(shut, np.maximum(word - least, 0), 0), first)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    pair, times = np.unique(doc[~shut] * len(names) + inv[~shut], return_counts=True)
    open_ = pa.StructArray.from_arrays([pa.array(_vec.signed(names[pair % len(names)])), pa.array(times.astype(np.int32))], fields=list(OPEN))
    return out, pa.ListArray.from_arrays(pa.array(np.searchsorted(pair // len(names), np.arange(n + 1)).astype(np.int32)), open_)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, spread and weights (the constant last) of a ridge logistic fit by Newton steps."""
    centre, spread = x.mean(0), x.std(0) + 1e-9
    z = np.concatenate([(x - centre) / spread, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return centre, spread, w


class Model:
    """vocabulary: the counts of all labelled words, as written."""

    def __init__(self, vocabulary: DataFrame):
        self.vocabulary = vocabulary
        self.curve: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(FIGURES), np.ones(FIGURES), np.zeros(FIGURES + 1))


def figures(rows: DataFrame, model: Model) -> DataFrame:
    """(key, f0, f1, ...) of every row of (key, text), from the log ratios of its words.

    The ratios of the most frequent words travel to the executors; those of the others meet them in a join, in which no
    word is frequent.
    """
    scratch = Scratch(rows.sparkSession, "toxicity")
    asked = scratch.put(rows.select("text", F.lit(-1).alias("y")).mapInArrow(_vocabulary, VOCABULARY), "asked")
    words = ratios(model.vocabulary.unionByName(asked), scratch)
    scratch.drop("asked")
    # By sixteenths of powers of two, so that a few hundred counts say where the most frequent words begin, whatever their number.
    words = words.withColumn("level", F.floor(F.log2("n") * 16).cast("int"))
    kinds = words.groupBy("level").agg(F.count(F.lit(1)).alias("kinds")).toArrow().to_pandas().sort_values("level", ascending=False)
    fits = kinds[kinds["kinds"].cumsum() <= MOST_KNOWN]["level"]
    least = int(fits.min()) if len(fits) else 1 << 20
    top = words.where(F.col("level") >= least).select("w", "r").toArrow()
    known = rows.sparkSession.sparkContext.broadcast(Table(top["w"].to_numpy().view(np.uint64), top["r"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in _vec.slices(batch.column(2)):
                x, open_ = _sums(known.value, data, offs)
                yield pa.record_batch([*(batch.column(k).slice(lo, hi - lo) for k in (0, 1)), *(pa.array(x[:, j].copy()) for j in range(len(SUMS))), open_], names=["row", "key", *SUMS, "open"])

    kind = rows.schema["key"].dataType.simpleString()
    sums = rows.select(F.monotonically_increasing_id().alias("row"), "key", "text")
    sums = sums.mapInArrow(run, f"row bigint, key {kind}, {', '.join(f'{c} double' for c in SUMS)}, open array<struct<w: bigint, times: int>>")
    sums = scratch.put(sums, "sums")
    opened = sums.select("row", F.explode("open").alias("open")).select("row", "open.*")
    beyond = [F.sum(F.greatest(F.col("r") - F.lit(x), F.lit(0.0)) * F.col("times")) for x in STRONG]
    late = opened.join(words.where(F.col("level") < least).select("w", "r"), "w")
    late = late.groupBy("row").agg(F.sum(F.col("r") * F.col("times")).alias("s_"), F.max("r").alias("m_"), *(x.alias(f"c{k}_") for k, x in enumerate(beyond)))
    both = sums.drop("open").join(late, "row", "left")
    s, c0, c1 = (F.col(x) + F.coalesce(f"{x}_", F.lit(0.0)) for x in ("s", "c0", "c1"))
    n = F.col("n")
    made = [s / n, F.greatest("m", "m_"), c0 / n, c0 / F.sqrt(n), c1 / n, c1 / F.sqrt(n)]
    return both.select("key", *(F.when(n > 0, x).otherwise(0.0).alias(f"f{j}") for j, x in enumerate(made)))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """A model from labelled rows, but for those of held-out fold 2; None without both classes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    marks = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where("key is not null and y is not null")
    marks = marks.groupBy("key").agg(F.max("y").alias("y")).withColumn("part", fold(F.col("key"), 4)).where("part != 2")
    chosen = scratch.put(marks.where("part = 3").select("key", "y").orderBy(F.xxhash64("key"), "key").limit(CURVE_ROWS), "curve")
    learnt = marks.join(F.broadcast(chosen.select("key")), "key", "left_anti")
    learnt = with_text(rows, learnt.select("key", (F.col("y") == 1).cast("int").alias("y"))).select("text", "y")
    model = Model(scratch.put(learnt.mapInArrow(_vocabulary, VOCABULARY), "vocabulary"))
    census = model.vocabulary.agg(F.sum("o"), F.sum("t")).first()
    if not census[0] or not census[1]:
        return None
    x = figures(with_text(rows, chosen, bounded=True).select(F.col("y").alias("key"), "text"), model).toArrow().to_pandas()
    if x["key"].nunique() < 2:
        return None
    model.curve = logistic(x[[f"f{j}" for j in range(FIGURES)]].to_numpy(), (x["key"] == 1).to_numpy(float))
    return model


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if model is None:
        return rows.select("key", F.lit(0.0).alias("score"))
    z = F.lit(float(model.curve[2][-1]))
    for j, (centre, spread, w) in enumerate(zip(*(x[:FIGURES].tolist() for x in model.curve), strict=True)):
        z = z + (F.col(f"f{j}") - F.lit(centre)) / F.lit(spread) * F.lit(w)
    z = F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))
    return figures(rows, model).select("key", (1 / (1 + F.exp(-z))).alias("score"))


def keep_ordinary(docs: DataFrame, model: Model | None, text: str = "text", cut: float = CUT) -> DataFrame:
    """Rows of ``docs``, all columns, whose score is under ``cut``."""
    if model is None:
        return docs
    # The score follows from the text alone, so texts are named by their digests.
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    gone = score(docs.select(digest.alias("_tarn_name"), text), model, "_tarn_name", text).where(F.col("score") >= cut).select("key").distinct()
    gone = Scratch(docs.sparkSession, "toxicity").put(gone.select(F.col("key").alias("_tarn_gone")), "gone")
    return docs.join(gone, digest == F.col("_tarn_gone"), "left_anti")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, fit(docs, labels)).withColumnRenamed("key", "doc_id")
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
