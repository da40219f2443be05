"""Benchmark decontamination by suffix arrays over shards of the training text.

Each task cuts its rows into shards, builds a word-level suffix array of each shard, and
binary-searches the suffixes of the benchmark items in it. Documents never leave their task: there is
no shuffle, whatever their number, and a hot source or a large group of copies changes nothing.

The suffix array is sparse: a suffix that begins with a word no item has can't match, so it isn't
sorted, and sorting stops where all ties are cut by such a word or are as deep as the search goes.
Words are compared by 64-bit hashes.

The benchmark is broadcast in blocks. Items are cut into pieces that overlap by a window less a word, so that a block's size doesn't
depend on how long an item is; a shard meets one block after another, and its texts are neither sent nor written again for that.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import carried, column, kept_columns, restored
from .text import ALNUM, Words, lean, pieces, words

WINDOW = 10
#: Words of the benchmark in one broadcast, about; and blocks that a worker keeps in memory.
BLOCK_WORDS, KEPT = 1_000_000, 4
_SHARD = 4 << 20


@dataclass
class Items:
    """A block of the benchmark. ids: its words as numbers from 1 in the order of vocabulary, 0 after each item."""

    names: list
    vocabulary: np.ndarray
    ids: np.ndarray
    item: np.ndarray  # of each test suffix
    start: np.ndarray  # of each test suffix, in ids
    left: np.ndarray  # words from there to the item's end
    size: np.ndarray  # words of the suffix's item


def index_items(names: list, texts: list) -> Items:
    w = words(pa.array(texts, pa.string()), ALNUM)
    h = w.hashes()
    vocabulary = np.unique(h)
    at = np.arange(len(w)) + w.row
    ids = np.zeros(len(w) + len(texts) + 1, np.int64)
    ids[at] = np.searchsorted(vocabulary, h) + 1
    size = w.counts()[w.row]
    return Items(names, vocabulary, ids, w.row, at, size - (np.arange(len(w)) - w.first[:-1][w.row]), size)


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions with ids > 0, sorted by the numbers from there on; 0 ends a suffix. Ties beyond depth numbers stay."""
    at = np.flatnonzero(ids)
    if not len(at):
        return at
    # as many numbers in one key as fit
    most = int(ids.max())
    first = 3 if most < 1 << 21 else 2 if most < 1 << 31 else 1
    bits = np.uint64(63 // first)
    pad = np.concatenate([ids, np.zeros(3, ids.dtype)]).astype(np.uint64)
    key = np.zeros(len(at), np.uint64)
    for k in range(first):
        key = (key << bits if first > 1 else key) | pad[at + k]
    order = np.argsort(key, kind="stable")
    sa, key = at[order], key[order]
    new = np.ones(len(sa), bool)
    new[1:] = key[1:] != key[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(sa)), 0))
    rank = np.zeros(len(ids) + 1, np.int64)  # of a group's first suffix, from 1; 0 for suffixes that end at once
    rank[sa] = head + 1
    last = np.append(new[1:], True)
    open_ = np.flatnonzero(~(new & last) & (pad[sa + first - 1] != 0))
    reach = first
    while len(open_) and reach < depth:
        pos = sa[open_]
        second = rank[np.minimum(pos + reach, len(ids))]
        third = np.where(second > 0, rank[np.minimum(pos + 2 * reach, len(ids))], 0)
        group = head[open_]
        order = np.lexsort((third, second, group))
        pos, group, second, third = pos[order], group[order], second[order], third[order]
        sa[open_] = pos
        fresh = np.ones(len(pos), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1]) | (third[1:] != third[:-1])
        lead = np.maximum.accumulate(np.where(fresh, np.arange(len(pos)), 0))
        head[open_] = open_[lead]
        rank[pos] = head[open_] + 1
        single = fresh & np.append(fresh[1:], True)
        open_ = open_[~single & (second > 0) & (third > 0)]
        reach *= 3
    return sa


def _bisect(ids, sa, lo, hi, d, want, right: bool):
    """In each range of sa, the first place whose number at distance d is at least want (or beyond it)."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        act = lo < hi
        if not act.any():
            return lo
        mid = (lo + hi) >> 1
        got = ids[np.minimum(sa[np.minimum(mid, len(sa) - 1)] + d, len(ids) - 1)]
        down = (got > want) if right else (got >= want)
        hi = np.where(act & down, mid, hi)
        lo = np.where(act & ~down, mid + 1, lo)


def search(ids: np.ndarray, sa: np.ndarray, items: Items, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each test suffix the range of sa with its window, empty where there is none; and the windows' words.

    A suffix has a window if window words of its item are left, or if it is the whole of a shorter item. No step goes deeper than that.
    """
    size = np.where(items.size >= window, window, items.size)
    has = np.where(items.size >= window, items.left >= window, items.left == items.size)
    win = np.zeros((2, len(items.start)), np.int64)
    live = np.flatnonzero(has)
    lo, hi, d = np.zeros(len(live), np.int64), np.full(len(live), len(sa), np.int64), 0
    while len(live):
        want = items.ids[items.start[live] + d]
        lo = _bisect(ids, sa, lo, hi, d, want, False)
        hi = _bisect(ids, sa, lo, hi, d, want, True)
        ok = lo < hi
        live, lo, hi, d = live[ok], lo[ok], hi[ok], d + 1
        full = size[live] == d
        win[0, live[full]], win[1, live[full]] = lo[full], hi[full]
        live, lo, hi = live[~full], lo[~full], hi[~full]
    return win, size


def longest(ids: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each test suffix: its longest match in ids, the first place of it, and how many places it has.

    Shard and items share one suffix array, in which the best match of a suffix is one of its two neighbours from the shard. Common prefixes
    are read off the ranks of 1, 2, 4, ... numbers, so a match of n words takes log n steps.
    """
    n = len(items.start)
    joint = np.concatenate([ids, items.ids])
    depth = int(items.size.max(initial=0))
    sa = suffix_array(joint, depth)
    levels = [joint]
    while 2 ** len(levels) <= depth:
        half, low = 2 ** (len(levels) - 1), levels[-1]
        second = np.append(low[half:], np.zeros(min(half, len(low)), low.dtype))
        rank = np.zeros(len(low), np.int64)
        some = np.flatnonzero((low > 0) & (second > 0))
        if not len(some):
            break
        rank[some] = np.unique(low[some].astype(np.int64) * (int(low.max()) + 1) + second[some], return_inverse=True)[1] + 1
        levels.append(rank)

    def common(a, b):
        out = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = np.minimum(a + out, len(joint) - 1), np.minimum(b + out, len(joint) - 1)
            out += np.where((levels[k][x] == levels[k][y]) & (levels[k][x] > 0), 2**k, 0)
        return out

    length, place, many = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    own = sa < len(ids)
    if not own.any() or not n:
        return length, place, many
    where = np.empty(len(joint), np.int64)
    where[sa] = np.arange(len(sa))
    p = items.start + len(ids)
    mine = where[p]
    rows = np.arange(len(sa))
    above = np.maximum.accumulate(np.where(own, rows, -1))[mine]
    below = np.minimum.accumulate(np.where(own, rows, len(sa))[::-1])[::-1][mine]
    for near, is_there in ((above, above >= 0), (below, below < len(sa))):
        length = np.maximum(length, np.where(is_there, common(p, sa[np.clip(near, 0, len(sa) - 1)]), 0))
    some = np.flatnonzero(length)
    ends = []
    for step in (-1, 1):  # how far the suffixes with that prefix reach, on either side
        inside, beyond = mine[some].copy(), np.full(len(some), -1 if step < 0 else len(sa))
        while (act := np.abs(beyond - inside) > 1).any():
            mid = (inside + beyond) >> 1
            near = common(p[some], sa[np.clip(mid, 0, len(sa) - 1)]) >= length[some]
            inside, beyond = np.where(act & near, mid, inside), np.where(act & ~near, mid, beyond)
        ends.append(inside)
    total = np.append(0, np.cumsum(own))
    many[some] = total[ends[1] + 1] - total[ends[0]]
    value = np.append(np.where(own, sa, len(joint)), len(joint))
    ranges, which = np.unique(np.stack([ends[0], ends[1] + 1], 1), axis=0, return_inverse=True)
    if len(some):
        place[some] = np.minimum.reduceat(value, ranges.ravel())[::2][which.ravel()]
    return length, place, many


def _spread(lo, hi):
    """All numbers of the ranges, and the range of each."""
    n = hi - lo
    of = np.repeat(np.arange(len(lo)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[of], of


def _ids(w: Words, h: np.ndarray, rows: int, items: Items) -> np.ndarray:
    """The shard's words as numbers; 0 where no item has the word, and after each document."""
    ids = np.zeros(len(w) + rows + 1, np.int64)
    if len(items.vocabulary):
        k = np.minimum(np.searchsorted(items.vocabulary, h), len(items.vocabulary) - 1)
        ids[np.arange(len(w)) + w.row] = np.where(items.vocabulary[k] == h, k + 1, 0)
    return ids


def match_shard(part: pa.RecordBatch, column: str, blocks, window: int):
    """Of each row: words, hit words, the items with windows in it as (row, name), and the runs of hit words as (row, first word, words)."""
    rows = part.num_rows
    w = words(part.column(column), ALNUM)
    h = w.hashes()
    row_of = np.repeat(np.arange(rows), w.counts() + 1)
    hit, found_in = np.zeros(len(w) + rows + 1, bool), set()
    for items in blocks:
        ids = _ids(w, h, rows, items)
        sa = suffix_array(ids, min(window, int(items.size.max(initial=0))))
        win, size = search(ids, sa, items, window)
        found = np.flatnonzero(win[0] < win[1])
        if not len(found):
            continue
        ranges, which = np.unique(np.stack([win[0][found], win[1][found], size[found]], 1), axis=0, return_inverse=True)
        pos, of = _spread(ranges[:, 0], ranges[:, 1])
        pos = sa[pos]
        change = np.zeros(len(ids) + 1, np.int64)
        np.add.at(change, pos, 1)
        np.add.at(change, pos + ranges[of, 2], -1)
        hit |= np.cumsum(change)[:-1] > 0
        # items by row: ranges by row without repeats first, so copies of a passage in one document count once
        per = np.unique(np.stack([of, row_of[pos]], 1), axis=0)
        pair = np.unique(np.stack([which.ravel(), items.item[found]], 1), axis=0)
        first = np.searchsorted(pair[:, 0], np.arange(len(ranges) + 1))
        j, k = _spread(first[per[:, 0]], first[per[:, 0] + 1])
        both = np.unique(np.stack([per[k, 1], pair[j, 1]], 1), axis=0)
        found_in.update((int(r), items.names[i]) for r, i in both.tolist())
    n_hit = np.bincount(row_of[np.flatnonzero(hit[: len(row_of)])], minlength=rows)
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    row = row_of[begin]
    return w.counts(), n_hit, sorted(found_in), (row, begin - row - w.first[row], end - begin)


def _lists(values, row: np.ndarray, rows: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), values)


_SPAN = pa.struct([("word", pa.int64()), ("n_words", pa.int64())])
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _item_rows(benchmark: DataFrame, item: str, text: str, window: int | None, step: int) -> DataFrame:
    """(i, t, n): the distinct items' words, blanks between; longer ones in pieces of `step` windows each, unless window is None."""
    t = F.coalesce(column(text).cast("string"), F.lit(""))
    low = F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    b = benchmark.select(F.coalesce(column(item).cast("string"), F.lit("null")).alias("i"), F.regexp_extract_all(low, F.lit(f"({_WORD})"), F.lit(1)).alias("w")).distinct()
    if window is not None:
        b = b.select("i", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(step))).alias("k"))
        b = b.select("i", F.slice("w", F.col("k") + 1, step + window - 1).alias("w"))
    return b.where("size(w) > 0").select("i", F.array_join("w", " ").alias("t"), F.size("w").alias("n"))


def _blocks(benchmark: DataFrame, item: str, text: str, window: int | None, block_words: int):
    """The items in broadcasts, each collected alone."""
    b = _item_rows(benchmark, item, text, window, max(1, block_words // 8))
    n = max(1, -(-int(b.agg(F.sum("n")).first()[0] or 0) // block_words))
    for k in range(n):
        rows = b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").toArrow()
        yield benchmark.sparkSession.sparkContext.broadcast(index_items(rows["i"].to_pylist(), rows["t"].to_pylist()))


class _Sent:
    """Broadcast blocks, one after another; of many, none stays in the worker's memory."""

    def __init__(self, sent: list):
        self.sent = sent

    def __iter__(self):
        for one in self.sent:
            yield one.value
            if len(self.sent) > KEPT:
                vars(one).pop("_value", None)  # read again from the worker's disk


_ADDED = ("n_words", "n_hit", "item_ids", "spans")


def _contamination(documents: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, keep: tuple[str, ...], window: int, block_words: int) -> DataFrame:
    """The kept columns by their places, and _ADDED."""
    docs, read = kept_columns(documents, keep, text)
    blocks = _Sent(list(_blocks(benchmark, item, item_text, window, block_words)))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, read, _SHARD):
                rows = part.num_rows
                n_words, n_hit, ids, (row, at, n) = match_shard(part, read, blocks, window)
                own = [
                    pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), _lists(pa.array([x for _, x in ids], pa.string()), np.array([r for r, _ in ids], np.int64), rows),
                    _lists(pa.StructArray.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], fields=list(_SPAN)), row, rows),
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried(keep)), *own], [*carried(keep), *_ADDED])

    kinds = ("bigint", "bigint", "array<string>", "array<struct<word:bigint,n_words:bigint>>")
    return docs.mapInArrow(lean(run), docs.select(*carried(keep), *(F.expr(f"cast(null as {t})").alias(n) for n, t in zip(_ADDED, kinds, strict=True))).schema)


def contamination(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text",
                  keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """documents' columns keep, and n_words, n_hit, item_ids (sorted strings) and spans of hit words.

    A window is `window` consecutive words of an item, or the whole of a shorter one; every word of a document inside an
    occurrence of any window is hit, and item_ids names the items with occurring windows.

    Null and empty texts have no words and no hits; null or wordless items match nothing; a null item id counts as "null", and items
    that share an id are one; a very long text is a shard of its own, a very long item several pieces; repeated rows of documents each give a
    row; no documents, no rows; other columns of either table are not read; one of keep that has a result's name gets _ at its end.
    """
    return restored(_contamination(documents, benchmark, text, item, item_text, keep, window, block_words), keep, *_ADDED)


def longest_matches(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", doc: str = "doc_id", item: str = "item_id", item_text: str = "text",
                    block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each word of each item, the longest verbatim match of the suffix from there on in any document, and one place of it.

    Columns: item_id, item_word, n_words, doc_id and doc_word of a match (of equal ones that with the smallest doc_id, null last, and word)
    and n_places, in how many places it occurs, those in repeated rows included; of one doc_id's several texts, the place is in any. Suffixes without any match have no row, nor have null and
    empty texts or items; items that share an id and differ in text give rows of that id each. Items aren't cut here, so a block is as large as its longest item.
    """
    out = None
    docs = documents.select(column(doc).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    for sent in _blocks(benchmark, item, item_text, None, block_words):

        def run(batches, sent=sent):
            own = sent.value
            for batch in batches:
                for part in pieces(batch, "text", _SHARD):
                    part = part.sort_by("doc_id")  # a shard's first place is then in the smallest doc_id, null last
                    w = words(part.column("text"), ALNUM)
                    length, place, many = longest(_ids(w, w.hashes(), part.num_rows, own), own)
                    row_of = np.repeat(np.arange(part.num_rows), w.counts() + 1)
                    some = np.flatnonzero(length)
                    at = place[some]
                    row = row_of[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([own.names[i] for i in own.item[some]], pa.string()), pa.array((own.size - own.left)[some], pa.int64()), pa.array(length[some], pa.int64()), part.column("doc_id").take(pa.array(row)), pa.array(at - row - w.first[row], pa.int64()), pa.array(many[some], pa.int64())],
                        ["item_id", "item_word", "n_words", "doc_id", "doc_word", "n_places"])

        got = docs.mapInArrow(lean(run), "item_id string, item_word long, n_words long, doc_id long, doc_word long, n_places long")
        out = got if out is None else out.unionByName(got)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc_word")
    return out.groupBy("item_id", "item_word", "n_words").agg(F.min(place).alias("p"), F.sum("n_places").alias("n_places")).groupBy("item_id", "item_word").agg(F.max_by(F.struct("p", "n_places"), "n_words").alias("x"), F.max("n_words").alias("n_words")).select("item_id", "item_word", "n_words", "x.p.doc_id", "x.p.doc_word", "x.n_places")


def clean(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """documents without the rows in which a window of the benchmark occurs; all columns stay, whatever their names. Null and empty texts stay, and repeated rows as they are."""
    names = tuple(documents.columns)
    scored = _contamination(documents, benchmark, text, item, item_text, names, window, block_words)
    return scored.where("n_hit = 0").select(*(F.col(f"k_{i}").alias(c) for i, c in enumerate(names)))


def item_digest(item_ids: Column) -> Column:
    """Hex SHA-256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(item_ids), ","), 256)
