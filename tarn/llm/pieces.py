"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled into three machines:

* the normaliser N: marks white space, puts a space before the text, and rewrites by the model's character map;
* the lexicon L: one path for each piece, from its symbols to its id with the piece's weight, and a fallback path for
  any symbol that is no piece, to the ids of its UTF-8 bytes;
* for merge models, the acceptor M over pairs of ids: weight 0 if merging the two pieces' joined text gives just these
  two again, infinity otherwise. A sequence is what merging gives if and only if all its neighbours pass M.

Encoding composes the input with N, L and M and takes the path of least weight in the tropical semiring (sum along a
path, minimum over paths). The composition's states are (place, last piece); under M every place has one finite state,
which the recursion finds from the left. No piece holds a space mark after another symbol, so composition falls apart at
those places: chunks are solved together, many at a time, as arrays, and each worker remembers a bounded number of
them, by 64-bit hashes of their characters.
Chunks of more than ``LONG`` symbols (text without spaces) are solved one by one, in memory linear in their length.

Decoding is the inverse: ids to their bytes, space marks to spaces, without the space put before the text.

Defined cases: null text is empty, an empty text has no ids; ids outside the vocabulary are an error; a model whose
character map isn't the identity is normalised by the library's own table; long texts and texts without any space are
ordinary; repeated rows are encoded alike; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import array
import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec
from ._memo import Pool, names_of
from ._store import bound_batches

MARK = "▁"
#: Chunks that a worker remembers, and the symbols up to which chunks are solved together and remembered.
MEMO, LONG, PART = 400_000, 64, 1 << 16
U = np.uint64
PREFIX = 1 << 30
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


class Slots:
    """uint64 keys to int64 values, open addressing, all keys placed."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int64)
        rest, probe = np.arange(len(keys)), 0
        while len(rest):
            slot = self._slot(keys[rest], probe)
            free = self.values[slot] < 0
            taken, first = np.unique(slot[free], return_index=True)
            at = rest[np.flatnonzero(free)[first]]
            self.keys[taken], self.values[taken] = keys[at], values[at]
            rest = np.setdiff1d(rest, at, assume_unique=True)
            probe += 1
        self.probes = probe

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return (_vec.mix(keys + U(probe)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for probe in range(self.probes):
            slot = self._slot(keys[rest], probe)
            hit = (self.keys[slot] == keys[rest]) & (self.values[slot] >= 0)
            out[rest[hit]] = self.values[slot[hit]]
            rest = rest[~hit & (self.values[slot] >= 0)]
            if not len(rest):
                break
        return out


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kind = model.normalizer_spec, model.trainer_spec.model_type
        self.merges = kind == 2
        if kind not in (1, 2):
            raise ValueError("only unigram and merge models can be compiled")
        self.prefix = norm.add_dummy_prefix
        self.squeeze = norm.remove_extra_whitespaces
        self.library = None
        if norm.precompiled_charsmap:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.score = {}
        self.id_of: dict[str, int] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [-1] * 256
        self.unknown = 0
        for k, p in enumerate(model.pieces):
            self.bytes_of.append(p.piece.replace(MARK, " ").encode())
            if p.type in (NORMAL, USER):
                self.id_of[p.piece], self.score[k] = k, p.score
            elif p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = k
                self.bytes_of[k] = bytes([int(p.piece[3:5], 16)])
            else:
                self.bytes_of[k] = b""
                if p.type == UNKNOWN:
                    self.unknown, self.bytes_of[k] = k, b" \xe2\x81\x87 "
        self.longest = max(map(len, self.id_of))
        self.score_of = {p: self.score[k] for p, k in self.id_of.items()}
        self.apart = not any(MARK in p.lstrip(MARK) for p in self.id_of)
        # L as a table of all beginnings of pieces; what is a beginning only goes to PREFIX.
        names = sorted({p[:k] for p in self.id_of for k in range(1, len(p) + 1)})
        self.lexicon = Slots(np.array([self._name(np.array([ord(c) for c in p], np.uint64)) for p in names], np.uint64), np.array([self.id_of.get(p, PREFIX) for p in names]))
        self.pair_keys, self.pair_ok = np.zeros(1 << 20, np.uint64), np.zeros(1 << 20, bool)
        self.memo = Pool(MEMO, np.int32)
        #: The bytes of all pieces one after another, and where each begins (one more at the end).
        self.body = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.begins = np.concatenate(([0], np.cumsum([len(x) for x in self.bytes_of])))

    @staticmethod
    def _name(symbols: np.ndarray) -> int:
        return int((_vec.mix(symbols + U(1)) * _vec.PLACE[: len(symbols)]).sum(dtype=np.uint64) + U(len(symbols)))

    # The normaliser N.
    def normalise(self, text: str) -> str:
        if self.library is not None:
            return self.library.normalize(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return ((" " if self.prefix else "") + text).replace(" ", MARK)

    # The acceptor M.
    def passes(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """M for arrays of pairs; -1 on either side is the start or a fallback symbol, which nothing merges with."""
        out = (left < 0) | (right < 0)
        at = np.flatnonzero(~out)
        if not len(at):
            return out
        code = (left[at].astype(np.uint64) << U(24) | right[at].astype(np.uint64)) + U(1)
        slot = (_vec.mix(code) >> U(44)).astype(np.int64)
        new = np.flatnonzero(self.pair_keys[slot] != code)
        if len(new):
            codes, first = np.unique(code[new], return_index=True)
            ok = np.array([self._pair(int(left[at[k]]), int(right[at[k]])) for k in new[first]], bool)
            # Two new pairs may want one slot: answers go out first, the memo keeps either.
            known = ok[np.searchsorted(codes, code[new])]
            got = self.pair_ok[slot]
            got[new] = known
            self.pair_keys[slot[new]] = code[new]
            self.pair_ok[slot[new]] = known
            out[at] = got
            # Of new pairs that share a slot the last key and the last answer were kept, which belong together.
            return out
        out[at] = self.pair_ok[slot]
        return out

    def _pair(self, left: int, right: int) -> bool:
        """Whether merging the symbols of two pieces ends with just these two.

        Merging joins the neighbours that form the best piece first, the leftmost of equals; a step over the border
        between the two settles it.
        """
        a, b = self.pieces[left], self.pieces[right]
        symbols, border, get, none = [*a, *b], len(a), self.score_of.get, -np.inf
        scores = [get(x + y, none) for x, y in itertools.pairwise(symbols)]
        while scores and (best := max(scores)) > none:
            k = scores.index(best)
            if k == border - 1:
                return False
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del scores[k]
            border -= k < border
            if k:
                scores[k - 1] = get(symbols[k - 1] + symbols[k], none)
            if k < len(scores):
                scores[k] = get(symbols[k] + symbols[k + 1], none)
        return symbols == [a, b]

    # Composition and the shortest path.
    def solve(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids of normalised chunks; shorter ones are padded, since a path's start knows nothing of its end."""
        sizes = np.array([len(c) for c in chunks])
        n, many = int(sizes.max()), len(chunks)
        cps = np.frombuffer("".join(c.ljust(n, "\0") for c in chunks).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(many, n).astype(np.uint64)
        marks = _vec.mix(cps + U(1))
        marks = np.ascontiguousarray(marks.T)
        arcs: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(n + 1)]  # by end: start, chunks, ids (-1: fallback)
        for i in range(n):
            at = np.flatnonzero(sizes > i)
            name = np.zeros(len(at), np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                name = name + marks[j - 1][at] * _vec.PLACE[j - 1 - i]
                got = self.lexicon.find(name + U(j - i))
                known = (got >= 0) & (got < PREFIX)
                if j == i + 1:
                    arcs[j].append((i, at, np.where(known, got, -1)))
                elif known.any():
                    arcs[j].append((i, at[known], got[known]))
                on = got >= 0
                if not on.any():
                    break
                at, name = at[on], name[on]
        weight = np.full((n + 1, many), np.inf)
        weight[0] = 0
        last = np.full((n + 1, many), -1, np.int32)
        back = np.zeros((n + 1, many), np.int32)
        for j in range(1, n + 1):
            for i, at, got in arcs[j]:
                can = np.isfinite(weight[i][at])
                if self.merges:
                    can &= ~np.isfinite(weight[j][at])
                    at, got = at[can], got[can]
                    use = self.passes(last[i][at], got)
                    cost = 0.0
                else:
                    at, got = at[can], got[can]
                    cost = np.where(got >= 0, -self.weights[np.maximum(got, 0)], self.penalty) + weight[i][at]
                    use = cost < weight[j][at]
                    cost = cost[use]
                at = at[use]
                weight[j][at], last[j][at], back[j][at] = cost, got[use], i
        # Back from the end of each chunk, all chunks at once: a row of ``path`` has the id that ends at that place, or none.
        path, ends = np.full((n + 1, many), -2, np.int32), sizes.copy()
        for j in range(n, 0, -1):
            at = np.flatnonzero(ends == j)
            path[j, at] = last[j, at]
            ends[at] = back[j, at]
        flat = path.T[path.T != -2]
        stop = np.cumsum((path != -2).sum(0))
        out = [flat[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]
        for c in np.flatnonzero((path == -1).any(0)).tolist():
            places = np.flatnonzero(path[:, c] != -2).tolist()
            out[c] = np.array([x for j in places for x in ((path[j, c],) if path[j, c] >= 0 else self.fallback(chunks[c][j - 1]))], np.int32)
        return out

    def solve_long(self, chunk: str) -> bytes:
        """Ids of one normalised chunk of any length: arcs are looked up by parts, states are kept for each place only."""
        n, weight, last, back = len(chunk), [0.0], array.array("i", [-1]), array.array("q", [0])
        known: dict[int, bool] = {}
        for lo in range(0, n, PART):
            hi = min(n, lo + PART)
            begin = max(0, lo + 1 - self.longest)
            marks = _vec.mix(np.frombuffer(chunk[begin:hi].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + U(1))
            name, ends, widths, ids = np.zeros(len(marks), np.uint64), [], [], []
            for w in range(1, min(self.longest, len(marks)) + 1):
                name = name[: len(marks) - w + 1] + marks[w - 1 :] * _vec.PLACE[w - 1]
                got = self.lexicon.find(name + U(w))
                got[got >= PREFIX] = -1
                at = np.flatnonzero((got >= 0) | (w == 1))
                at = at[at + begin + w > lo]
                ends.append(at + begin + w)
                widths.append(np.full(len(at), w))
                ids.append(got[at])
            ends, widths, ids = (np.concatenate(x) for x in (ends, widths, ids))
            order = np.lexsort((-widths, ends))
            for j, w, got in zip(ends[order].tolist(), widths[order].tolist(), ids[order].tolist(), strict=True):
                if len(weight) == j:
                    weight.append(np.inf)
                    last.append(-1)
                    back.append(0)
                before = weight[j - w]
                if before == np.inf or self.merges and weight[j] != np.inf:
                    continue
                if not self.merges:
                    cost = before + (self.penalty if got < 0 else -self.score[got])
                else:
                    left, cost = last[j - w], 0.0
                    if left >= 0 and got >= 0:
                        pair = left << 24 | got
                        if pair not in known:
                            if len(known) > 1 << 20:
                                known.clear()
                            known[pair] = self._pair(left, got)
                        if not known[pair]:
                            continue
                if cost < weight[j]:
                    weight[j], last[j], back[j] = cost, got, j - w
        path, j = array.array("i"), n
        while j > 0:
            path.extend((last[j],) if last[j] >= 0 else self.fallback(chunk[j - 1])[::-1])
            j = back[j]
        return path[::-1].tobytes()

    @functools.cached_property
    def weights(self) -> np.ndarray:
        return np.array([self.score.get(k, 0.0) for k in range(len(self.pieces))])

    @functools.cached_property
    def penalty(self) -> float:
        return 10.0 - min(self.score.values())

    def fallback(self, symbol: str) -> list[int]:
        ids = [self.byte_ids[b] for b in symbol.encode("utf-8", "replace")]
        return ids if min(ids) >= 0 else [self.unknown]

    def make(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids of normalised chunks, those of like length together."""
        order = sorted(range(len(chunks)), key=lambda k: len(chunks[k]))
        new = [chunks[k] for k in order]
        out: list[np.ndarray] = []
        lo = 0
        while lo < len(new):
            n = len(new[lo])
            most = max(1, 600_000 // (n * min(n, self.longest)))
            hi = lo + 1
            while hi < len(new) and hi - lo < most and len(new[hi]) <= n + 1 + n // 4:
                hi += 1
            out += self.solve(new[lo:hi])
            lo = hi
        back = [out[0]] * len(chunks)
        for k, ids in zip(order, out, strict=True):
            back[k] = ids
        return back

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and where each text's begin (one more at the end)."""
        normal = [self.normalise(t) for t in texts]
        text, offs = "".join(normal), np.concatenate(([0], np.cumsum([len(t) for t in normal]))).astype(np.int64)
        if not text:
            return np.zeros(0, np.int32), offs
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.zeros(len(cps), bool)
        if self.apart:
            mark = cps == ord(MARK)
            begin[1:] = mark[1:] & ~mark[:-1]
        begin[offs[:-1][offs[:-1] < offs[1:]]] = True
        start = np.flatnonzero(begin)
        name, size = names_of(cps, start)
        names, first, inv = np.unique(name, return_index=True, return_inverse=True)
        first, far = start[first], size[first]
        known = far <= LONG
        chunk = lambda k: text[first[k] : first[k] + far[k]]
        short = np.flatnonzero(known)
        places = np.full(len(names), -1)
        places[short] = self.memo.places(names[short], lambda new: self.make([chunk(short[k]) for k in new]))
        got, stop = self.memo.gather(np.maximum(places[inv], 0) * known[inv])
        if not known.all():
            # Long chunks are put between the others, without being remembered.
            long = {k: np.frombuffer(self.solve_long(chunk(k)), np.int32) for k in np.flatnonzero(~known).tolist()}
            lo = np.concatenate(([0], stop))
            parts = [long[k] if k in long else got[a:b] for k, a, b in zip(inv.tolist(), lo[:-1].tolist(), lo[1:].tolist(), strict=True)]
            got, stop = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        return got, np.concatenate(([0], stop))[np.searchsorted(start, offs)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, bounds = self.encode_all(texts)
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def same(self, ids: np.ndarray, bounds: np.ndarray, texts: list[str]) -> list[bool]:
        """Whether decoding the ids gives the texts again."""
        n = np.diff(self.begins)[ids]
        stop = np.cumsum(n)
        body = self.body[np.repeat(self.begins[ids] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)].tobytes()
        at = np.concatenate(([0], stop))[bounds].tolist()
        out = []
        for k, (t, a, b) in enumerate(zip(texts, at[:-1], at[1:], strict=True)):
            lead = self.prefix and body[a : a + 1] == b" " and b > a
            # What isn't equal as bytes is decoded as text, with a sign in place of what is no character.
            out.append(body[a + lead : b] == t.encode("utf-8", "surrogatepass") or self.decode(ids[bounds[k] : bounds[k + 1]]) == t)
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@functools.lru_cache(2)
def transducer(path: str) -> Transducer:
    """One for each worker process, kept between tasks."""
    return Transducer(path)


_vec.MEMOS.append(transducer.cache_clear)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_crc32, round_trip, ids): round_trip says whether decoding the ids gives the text again."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _vec.trim()
        machine = transducer(model)
        for batch in batches:
            for lo, hi, _, _ in _vec.slices(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                ids, ends = machine.encode_all(texts)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                body = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in itertools.pairwise(ends.tolist())]
                same = machine.same(ids, ends, texts)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_()), lists], names=["id", "n_tokens", "ids_crc32", "round_trip", "ids"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_crc32 bigint, round_trip boolean, ids array<int>")


def decode(rows: DataFrame, model: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            texts = [None if x is None else machine.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("ids").withColumnRenamed("id", "doc_id")
