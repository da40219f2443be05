"""Byte-level BPE encoding and decoding by replaying merges over all distinct words at once.

Each task reads its texts in large parts and numbers the distinct pre-tokens it meets. The new ones of a part
are encoded together: an inverted index maps each token pair, by the rank of its merge, to the positions where it stands,
and the merges are applied in rank order to all their positions at once. A merge only touches its two neighbours,
whose new pairs go to the index. Encoded pre-tokens are remembered by the worker, up to a bounded number.
There is no shuffle; the broadcast is the vocabulary file.
"""

from __future__ import annotations

import base64
import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import carried, kept_columns, restored
from .text import lean, pieces

_NONE = np.iinfo(np.int32).max
#: Text bytes of a part, distinct pre-tokens that a worker remembers, and a text's characters beyond which matches are not listed at once.
_PART, _REMEMBER, _LONG = 12 << 20, 300_000, 4 << 20


class Vocabulary:
    """Ranks of byte strings, from the lines of a rank file: base64 bytes and rank."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
        get = self.ranks.get
        pairs = {(a << 32) | b: r for t, r in self.ranks.items() if len(t) > 1 for k in range(1, len(t)) if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None}
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.merged = keys, np.array([pairs[k] for k in keys.tolist()], np.int32)
        left, right = keys >> 32, keys & 0xFFFFFFFF
        #: Tokens that are a half of one with a lower rank: after such a merge an earlier rank can come up in the same word.
        self.early = {*left[self.merged < left].tolist(), *right[self.merged < right].tolist()}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(a), _NONE, np.int32)
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.merged[at], _NONE).astype(np.int32)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words one after another, and how many each word has."""
        size = np.array([len(w) for w in words], np.int64)
        n = int(size.sum())
        if not n:
            return np.zeros(0, np.int32), size
        tok = np.append(self.byte[np.frombuffer(b"".join(words), np.uint8)], np.int32(-1))
        word = np.append(np.repeat(np.arange(len(words)), size), -1)
        following, before = np.arange(1, n + 2), np.arange(-1, n)
        stop = np.cumsum(size)
        stop = stop[size > 0]
        following[stop - 1] = n
        begin = np.append(0, stop[:-1])
        before[begin] = n
        following[n] = before[n] = n
        rank = np.append(self.rank(tok[:n], tok[following[:n]]), np.int32(_NONE))
        alive = np.ones(n + 1, bool)
        alive[n] = False
        index: dict[int, list] = {}
        heap: list[int] = []

        def put(at):
            r = rank[at]
            some = r != _NONE
            at, r = at[some], r[some]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            for key, group in zip(r[np.append(0, cut)].tolist(), np.split(at, cut), strict=True):
                if key in index:
                    index[key].append(group)
                else:
                    index[key] = [group]
                    heapq.heappush(heap, key)

        put(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            groups = index.pop(r)
            at = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if r in self.early and len(at) > 1:  # one a word, the leftmost; the others wait for what it brings up
                first = np.append(True, word[at[1:]] != word[at[:-1]])
                if not first.all():
                    index[r] = [at[~first]]
                    heapq.heappush(heap, r)
                    at = at[first]
            if len(at) > 1 and (chained := following[at[:-1]] == at[1:]).any():  # of overlapping places each second one
                lead = np.append(True, ~chained)
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(lead, place, 0))) % 2 == 0]
            gone = following[at]
            after = following[gone]
            tok[at] = r
            alive[gone] = False
            rank[gone] = _NONE
            following[at] = after
            before[after] = at
            before[n] = n
            prior = before[at]
            touched = np.concatenate([at, prior[prior < n]])
            if len(touched) > len(at):
                touched = np.unique(touched)
            rank[touched] = self.rank(tok[touched], tok[following[touched]])
            put(touched)
        keep = np.flatnonzero(alive)
        return tok[keep], np.bincount(word[keep], minlength=len(words))


class Encoder:
    """Texts to token ids; remembers the pre-tokens met, up to _REMEMBER."""

    def __init__(self, data: bytes, pattern: str):
        import regex

        self.vocabulary, self.pattern = Vocabulary(data), regex.compile(pattern)
        self.forget()
        v = self.vocabulary
        size = max(v.bytes_of) + 1
        length = np.array([len(v.bytes_of.get(i, b"")) for i in range(size)], np.int64)
        self.token_bytes = np.frombuffer(b"".join(v.bytes_of.get(i, b"") for i in range(size)), np.uint8)
        self.token_size, self.token_at = length, np.cumsum(length) - length

    def forget(self):
        self.codes: dict[str, int] = {}
        self.flat, self.at, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _number(self, text: str) -> np.ndarray:
        codes = self.codes
        found = self.pattern.findall(text) if len(text) <= _LONG else (m[0] for m in self.pattern.finditer(text))
        out: list = []
        while block := list(islice(found, 1 << 20)) if not isinstance(found, list) else found:
            for x in set(block).difference(codes):
                codes[x] = len(codes)
            out.append(np.fromiter(map(codes.__getitem__, block), np.int32, len(block)))
            if block is found:
                break
        return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.int32), *out])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.codes) > _REMEMBER:
            self.forget()
        numbered = [self._number(x) for x in texts]
        if len(self.codes) > len(self.size):
            new = [x.encode() for x in islice(self.codes, len(self.size), None)]
            # a pre-token that is a token itself needs no merges
            whole = [self.vocabulary.ranks.get(x) for x in new]
            ids, size = self.vocabulary.replay([b"" if r is not None else x for x, r in zip(new, whole, strict=True)])
            single = np.array([-1 if r is None else r for r in whole], np.int64)
            total = np.where(single >= 0, 1, size)
            flat = np.empty(int(total.sum()), np.int32)
            at = np.cumsum(total) - total
            of = np.repeat(single >= 0, total)
            flat[of], flat[~of] = single[single >= 0], ids
            self.at = np.append(self.at, at + len(self.flat))
            self.flat, self.size = np.append(self.flat, flat), np.append(self.size, total)
        return [gather(self.flat, self.at[c], self.size[c]) for c in numbered]

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.token_bytes, self.token_at[ids], self.token_size[ids]).tobytes()


def gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of flat that begin at `at`, one after another."""
    total = int(size.sum())
    return flat[np.arange(total) + np.repeat(at - (np.cumsum(size) - size), size)]


_ENCODERS: dict = {}


def encoder(data: bytes, pattern: str) -> Encoder:
    """One for each worker process; what it has learned serves later tasks."""
    key = (hash(data), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(data, pattern)
    return _ENCODERS[key]


def encode(documents: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decode: bool = False) -> DataFrame:
    """documents' columns keep, n_tokens, and ids, the token ids as little-endian unsigned 32-bit integers; with decode
    also decoded, the bytes that the ids stand for, found from the ids alone.

    No special tokens. Null texts are empty, and empty ones have no ids; repeated rows each give a row; no rows give no rows; a very long
    text is encoded whole; columns not in keep are not read, and one of keep that has a result's name gets _ at its end. ranks_path is a file on the driver; its content is broadcast.
    """
    with open(ranks_path, "rb") as f:
        data = documents.sparkSession.sparkContext.broadcast(f.read())
    docs, read = kept_columns(documents, keep, text)
    extra = [("n_tokens", "bigint", pa.int64()), ("ids", "binary", pa.binary())] + [("decoded", "binary", pa.binary())] * decode

    def run(batches):
        enc = encoder(data.value, pattern)
        for batch in batches:
            for part in pieces(batch, read, _PART):
                ids = enc.encode([x or "" for x in part.column(read).to_pylist()])
                for a in range(0, len(ids), 512):  # small batches to the JVM
                    some = ids[a : a + 512]
                    own = [pa.array([len(x) for x in some], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in some], pa.binary())]
                    own += [pa.array([enc.decode(x) for x in some], pa.binary())] * decode
                    yield pa.RecordBatch.from_arrays([*(part.column(c).slice(a, len(some)) for c in carried(keep)), *own], [*carried(keep), *(n for n, _, _ in extra)])

    schema = docs.select(*carried(keep), *(F.expr(f"cast(null as {t})").alias(n) for n, t, _ in extra)).schema
    return restored(docs.mapInArrow(lean(run), schema), keep, *(n for n, _, _ in extra))


def decode(encoded: DataFrame, ranks_path: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded and a column `out` (instead of one of that name) of the bytes its ids stand for; null ids give null, empty ones no bytes; repeated rows stay."""
    with open(ranks_path, "rb") as f:
        data = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        enc = encoder(data.value, "")
        for batch in batches:
            got = [None if x is None else enc.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in batch.column(ids).to_pylist()]
            names = [n for n in batch.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(got, pa.binary())], [*names, out])

    base = encoded.drop(out)
    return base.mapInArrow(lean(run), base.select("*", F.expr("cast(null as binary)").alias(out)).schema)
