"""Maximal periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye, in numpy over many texts at once.

A run of period q that counts has at least max(6, 4 q) words, so each five words in it stand once more in their text. Only the stretches where all fives of words recur can hold
runs, and a run lies in one of them with what would extend it; a stretch is then a string of its own. All stretches of a piece of a batch are put in one string, parted by words that occur once:

1. names of all substrings of 2^k words by doubling give the suffix order, and how far any two suffixes (or prefixes, backwards) agree, in log steps;
2. Lempel-Ziv blocks follow from the nearest earlier suffixes on both sides in that order; for each block's borders the squares about them are found, which cover the
   leftmost occurrence of every kind of square;
3. walks from these squares to their rotations, one suffix link a step, complete the vocabulary: each kind of square is a place in the suffix tree, here an interval of the suffix order;
4. the occurrences of all kinds are read from their intervals; those of one period that follow each other word by word merge into a run.

Texts stay in their rows: no join and no shuffle. A task holds some 150 bytes a word of a piece's recurring stretches, and a piece is some megabytes of text, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import column
from .text import NONBLANK, buffers, lean, mix, pieces, words

#: Words of a run at least, and periods; words whose every group in a run recurs; bytes of texts in a piece; pairs of places compared at once.
LEAST, EXPONENT, GROUP = 6, 4, 5
PIECE, PAIRS = 3 << 20, 1 << 20


class Suffixes:
    """Suffix order of a string of whole numbers, and how far any two places agree. The string's first and last words must occur once in it."""

    def __init__(self, string: np.ndarray):
        n = self.n = len(string)
        kinds, name, count = np.unique(string, return_inverse=True, return_counts=True)
        head = np.concatenate([[0], np.cumsum(count)[:-1]])
        rank = head[name]
        self.names, width = [rank.astype(np.int32)], 1
        open_ = np.flatnonzero(count[name] > 1)
        while len(open_):
            after = open_ + width
            key = rank[open_] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            order = np.argsort(key, kind="stable")
            open_, key = open_[order], key[order]
            old = rank[open_]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.concatenate([[True], old[1:] != old[:-1]])
            index = np.arange(len(open_))
            here = old + np.maximum.accumulate(np.where(new, index, 0)) - np.maximum.accumulate(np.where(group, index, 0))
            rank = rank.copy()
            rank[open_] = here
            alone = new & np.append(new[1:], True)
            open_ = np.sort(open_[~alone])
            self.names.append(rank.astype(np.int32))
            width *= 2
        self.names.pop()  # in the last all are alone
        self.rank = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from places i and j on, which differ."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            step = (self.names[k][i] == self.names[k][j]) * np.int64(1 << k)
            i += step
            j += step
            total += step
        return total

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words up to and with places i and j, backwards."""
        i, j, total = i + 1, j + 1, np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i - (1 << k), j - (1 << k)
            step = ((a >= 0) & (b >= 0) & (self.names[k][a] == self.names[k][b])) * np.int64(1 << k)
            i -= step
            j -= step
            total += step
        return total

    def blocks(self) -> np.ndarray:
        """The places where Lempel-Ziv blocks begin: each is the longest stretch that begins earlier too, or one word."""
        longest = np.zeros(self.n, np.int64)
        for order in (self.order, self.order[::-1]):
            before = np.arange(-1, self.n - 1)  # the nearest earlier place on this side, by jumps over later ones
            late = np.flatnonzero((before >= 0) & (order[before] > order))
            while len(late):
                before[late] = before[before[late]]
                late = late[(before[late] >= 0) & (order[before[late]] > order[late])]
            some = np.flatnonzero(before >= 0)
            np.maximum.at(longest, order[some], self.ahead(order[some], order[before[some]]))
        steps, out, at = np.maximum(longest, 1).tolist(), [], 0
        while at < self.n:
            out.append(at)
            at += steps[at]
        return np.array(out)

    def intervals(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last but one suffix in the order that begin with the length words at each place: its place in the suffix tree."""
        common = np.concatenate([[-1], self.ahead(self.order[:-1], self.order[1:]), [-1]]).astype(np.int32)  # of each with the one before
        least = [common]
        while len(least[-1]) > 1 << (len(least) - 1):
            low, half = least[-1], 1 << (len(least) - 1)
            least.append(np.minimum(low[:-half], low[half:]))
        first, last = self.rank[at].copy(), self.rank[at] + 1
        for k in range(len(least) - 1, -1, -1):
            table = least[k]
            low = first - (1 << k) + 1
            first -= ((low >= 0) & (table[np.clip(low, 0, len(table) - 1)] >= length)) * np.int64(1 << k)
            last += ((last < len(table)) & (table[np.minimum(last, len(table) - 1)] >= length)) * np.int64(1 << k)
        return first, last


def squares(s: Suffixes, string: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of squares that cover the leftmost one of each kind."""
    begins = s.blocks()
    ends = np.append(begins[1:], s.n)
    following = np.append(ends[1:], s.n)
    found = []
    # squares whose second half begins in the block and passes its end, then those that begin in it or before and have their middle in it
    for border, most, way in ((ends, ends - begins, -1), (begins, following - begins, 1)):
        upto = np.concatenate([[0], np.cumsum(most)])
        for a in range(0, int(upto[-1]), PAIRS):
            index = np.arange(a, min(a + PAIRS, int(upto[-1])))
            block = np.searchsorted(upto, index, "right") - 1
            period = index - upto[block] + 1
            at, other = border[block], border[block] + way * period
            ok = np.flatnonzero((at < s.n) & (other < s.n))
            ok = ok[string[at[ok]] == string[other[ok]]]
            at, other, period = at[ok], other[ok], period[ok]
            back, on = s.behind(at - 1, other - 1), s.ahead(at, other)
            ok = np.flatnonzero(back + on >= period)
            first = np.minimum(at, other)[ok]
            found.append((np.maximum(first - back[ok], first - period[ok] + 1), period[ok]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def roots(s: Suffixes, first: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The smallest periods of stretches that have the given ones at least twice: those divided by each prime as often as a period is left."""
    period, rest = period.copy(), period.copy()

    def divided(some: np.ndarray, by: np.ndarray) -> None:
        while len(some):
            d = period[some] // by
            ok = s.ahead(first[some], first[some] + d) >= end[some] - first[some] - d
            some, by = some[ok], by[ok]
            period[some] //= by
            ok = period[some] % by == 0
            some, by = some[ok], by[ok]

    for p in range(2, isqrt(int(period.max(initial=1))) + 1):
        some = np.flatnonzero(rest % p == 0)
        if len(some):
            divided(some, np.full(len(some), p))
            while len(some):
                rest[some] //= p
                some = some[rest[some] % p == 0]
    some = np.flatnonzero(rest > 1)
    divided(some, rest[some])
    return period


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    """Distinct rows, sorted by the first column, then the next."""
    if not len(columns[0]):
        return list(columns)
    order = np.lexsort(columns[::-1])
    columns = [x[order] for x in columns]
    new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in columns], axis=0)])
    return [x[new] for x in columns]


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from each first on, count many, and of which each is."""
    of = np.repeat(np.arange(len(first)), count)
    return np.arange(len(of)) - np.repeat(np.cumsum(count) - count - first, count), of


def repeats(string: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, length, period) of all maximal runs that hold their smallest period twice at least; the string's first and last words must occur once in it."""
    s = Suffixes(string)
    at, period = squares(s, string)
    first = at - s.behind(at - 1, at + period - 1)
    end = at + period + s.ahead(at, at + period)
    # of one stretch's squares the smallest: an equal stretch's periods are its multiples
    first, end, period = _distinct(first, end, period)
    one = np.concatenate([[True], (first[1:] != first[:-1]) | (end[1:] != end[:-1])]) if len(first) else np.zeros(0, bool)
    first, end, period = first[one], end[one], period[one]
    period = roots(s, first, end, period)
    # the vocabulary: from each stretch's first square one rotation after the other, and each kind's interval once
    places, of = _spread(first, np.minimum(period, end - first - 2 * period + 1))
    low, high = s.intervals(places, 2 * period[of])
    period, low, high = _distinct(period[of], low, high)
    suffixes, of = _spread(low, high - low)
    place, period = s.order[suffixes], period[of]
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    if not len(place):
        return place, place, period
    new = np.concatenate([[True], (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1)])
    last = np.append(new[1:], True)
    return place[new], place[last] - place[new] + 2 * period[new], period[new]


def recurring(row: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last but one words of the stretches in which all groups of GROUP words recur in their row."""
    n = len(names) - GROUP + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(GROUP):
        key = mix(key + names[k : k + n])
    whole = np.flatnonzero(row[:n] == row[GROUP - 1 :])
    key = mix(key[whole] ^ row[whole].astype(np.uint64))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(whole), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    at = whole[again]
    if not len(at):
        return at, at
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])])
    return at[new], at[np.append(new[1:], True)] + GROUP


def runs_of(row: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, period) of the runs in rows of words, given each word's row and name; sorted by first word and period."""
    begins, ends = recurring(row, names)
    if not len(begins):
        none = np.zeros(0, np.int64)
        return none, none, none
    taken, of = _spread(begins, ends - begins)
    kinds, name = np.unique(names[taken], return_inverse=True)
    # one word that occurs once before each stretch and after the last
    string = np.empty(len(taken) + len(begins) + 1, np.int64)
    place = np.arange(len(taken)) + of + 1
    string[place] = name
    gaps = np.ones(len(string), bool)
    gaps[place] = False
    string[gaps] = len(kinds) + np.arange(len(begins) + 1)
    word = np.full(len(string), -1)
    word[place] = taken
    first, length, period = repeats(string)
    some = length >= np.maximum(LEAST, EXPONENT * period)
    first, period, length = _distinct(word[first[some]], period[some], length[some])
    return first, length, period


def _pieces_of_runs(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
    for piece in pieces(batch, "text", PIECE):
        w = words(piece.column("text"), NONBLANK, lower=False)
        first, length, period = runs_of(w.row, w.hashes())
        of = w.row[first]
        bounds = np.searchsorted(of, np.arange(piece.num_rows + 1)).tolist()
        every = list(zip((first - w.first[of]).tolist(), length.tolist(), period.tolist(), strict=True))
        found = [every[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield piece, found


def collapsed(text: bytes, found: list[tuple[int, int, int]]) -> bytes:
    """The text's words joined by blanks, without those that a run holds after its first period."""
    parts = text.split()
    if found:
        depth = np.zeros(len(parts) + 1, np.int64)
        for start, length, period in found:
            depth[start + period] += 1
            depth[start + length] -= 1
        parts = [parts[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist()]
    return b" ".join(parts)


def periodic_runs(documents: DataFrame, *, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """doc_id, runs and collapsed for each row of documents.

    runs: an array of (start, length, period) in words between blanks, by start and then period: the maximal stretches of at least max(6, 4 * period) words, period their
    smallest. collapsed: the words that stay when of each run only the first period does, joined by one blank. Null, empty and blank texts have no runs and an
    empty collapsed text; rows that are repeated or have no id are rows like others; no documents, no rows; a very long text is searched whole; other columns are not read.
    """
    kind = documents.schema[doc].dataType.simpleString()
    rows = documents.select(column(doc).alias("doc_id"), column(text).cast("string").alias("text"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for piece, found in _pieces_of_runs(batch):
                buf, offsets = buffers(piece.column("text"), False)
                raw = buf.tobytes()
                texts = [collapsed(raw[a:b], f).decode() for a, b, f in zip(offsets[:-1].tolist(), offsets[1:].tolist(), found, strict=True)]
                lists = pa.array([[{"start": a, "length": b, "period": c} for a, b, c in f] for f in found], run_type)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), lists, pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    return rows.mapInArrow(lean(run), f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_periodic_tails(documents: DataFrame, *, text: str = "text", doc: str = "doc_id", share: int = 10) -> DataFrame:
    """The documents (id and text), those with crc32(id) % share = 0 with a periodic end: from word a on they repeat the p words there; a = g % n and p = 1 + (n - a) div (3 + g % 8) of n words, g = crc32(id) div share.

    Null ids and texts, and texts without words, stay.
    """
    rows = documents.select(column(doc).alias(doc), column(text).cast("string").alias(text))
    rows = rows.withColumn("_h", F.crc32(column(doc).cast("string").cast("binary")))
    quoted = "`" + text.replace("`", "``") + "`"
    # the words are bound by a lambda, so the text is split once
    a, g = "(v.g % v.n)", "v.g"
    p = f"(1 + (v.n - {a}) div (3 + {g} % 8))"
    bound = f"array(named_struct('w', array_remove(split({quoted}, '[ \\\\t-\\\\r]+'), ''), 'g', _h div {share}))"
    sized = f"transform({bound}, u -> named_struct('w', u.w, 'n', size(u.w), 'g', u.g))"
    sized = f"transform({sized}, v -> named_struct('w', v.w, 'n', v.n, 'a', {a}, 'p', {p}))"
    edit = f"transform({sized}, v -> array_join(transform(sequence(0, v.n - 1), i -> get(v.w, CAST(CASE WHEN i >= v.a THEN v.a + (i - v.a) % v.p ELSE i END AS INT))), ' '))"
    return rows.withColumn(text, F.expr(f"CASE WHEN _h % {share} = 0 AND {quoted} RLIKE '[^ \\\\t-\\\\r]' THEN get({edit}, 0) ELSE {quoted} END")).drop("_h")
