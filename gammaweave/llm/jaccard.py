"""Exact Jaccard join of documents on word n-grams by vertical partitioning.

All n-grams have one global order: by hash, those found to be frequent after the others. Two sets that link must share one
of the first n - ceil(t n) + 1 n-grams of each in this order, with few enough before it, which gives the candidates. For these the global order
is cut into fragments; the overlap of a pair is counted in each fragment separately and summed per pair.

Equal sets are one class from the start, and only classes are compared. Classes that share a prefix n-gram are not paired with
each other: in each round, those of the group's first classes (its pivots) are paired with the rest, links found are
contracted, and groups that lie in one component are done. The first rounds take one and two pivots, later ones many times more, so a group whose classes
do link ends after a round or two with about as many pairs as members, and any other group has had all its pairs when its pivots
run out: no link is lost, nothing is capped.

No task holds a group that may be large. The sets that have an n-gram in their prefixes are counted exactly. The members of an n-gram of few lie together, and are numbered there. Those of any other are
dealt by (n-gram, salt); its first member and its size are grouped sums, and its other members' numbers are drawn from the hash of the
class, which is as good an order of pivots as any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sampling import column
from .shared import scratch
from .text import NONBLANK, lean, mix, pieces, words

NGRAM, PERCENT = 4, 85
#: An n-gram in so many sets of a part is counted; in so many in all, it is frequent and goes behind the others; in as many prefixes, it is dealt by salts. Any choice gives the same links.
LOCAL, FREQUENT, MOST_FREQUENT = 3, 24, 1 << 20
#: Fragments of the global order, salts of a frequent n-gram, and the most bits of a filter of documents that have candidates; a full one lets more through, no less.
FRAGMENTS, SALTS, MOST_FILTER_BITS = 4, 64, 1 << 30
#: Bits of a set's sketch, from 1.5 for each n-gram on (powers of two). A bit tells whether the n-grams that fall on it are odd in number, so where two sketches
#: differ, there are at least as many n-grams that the pair doesn't share. A coarse sketch is the same, folded to a half; small ones stay as they are.
LEAST_SKETCH, MOST_SKETCH = 64, 1 << 15
#: Beyond so many rows, classes, pairs (a row for each fragment) and labels are joined by merges.
MOST_SENT = 1 << 16
#: Text bytes of a part, and words of sketches that are made at once.
_PART, _SKETCHED = 3 << 20, 1 << 13
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def sets(column: pa.Array, ngram: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each row, as 64-bit hashes, sorted; and where each row's begin, one more than rows."""
    w = words(column, NONBLANK)
    h, n, first = w.hashes(), w.counts(), w.first
    at = np.arange(len(w)) - first[:-1][w.row]
    whole = at + ngram <= n[w.row]
    short = (at == 0) & (n[w.row] < ngram)
    code = np.zeros(len(w), np.uint64)
    for k in range(ngram):
        c = _C[k % 4] + np.uint64(2 * (k // 4))
        size = len(h) - k
        if size <= 0:
            break
        # of a short row only the words it has
        code[:size] += np.where(at[:size] + k < n[w.row[:size]], h[k:] * c, np.uint64(0))
    code = mix(code + np.where(short, n[w.row], 0).astype(np.uint64))
    keep = whole | short
    code, row = code[keep], w.row[keep]
    begin = np.searchsorted(row, np.arange(len(n) + 1))
    return _sorted(code, begin)


def _sorted(code: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        code[a:b].sort()
    fresh = np.ones(len(code), bool)
    fresh[1:] = code[1:] != code[:-1]
    starts = begin[:-1][begin[:-1] < len(code)]
    fresh[starts] = True
    total = np.append(0, np.cumsum(fresh))
    return code[fresh], total[begin]


def digests(code: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit sum for each set, equal for equal sets; 0 for an empty one."""
    total = np.zeros((1, len(code) + 1), np.uint64)
    np.cumsum(mix(code), out=total[0, 1:])
    return total[:, begin[1:]] - total[:, begin[:-1]]


def _once(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first row of each distinct set that isn't empty."""
    some = np.flatnonzero(n)
    return some[np.sort(np.unique(d[0, some], return_index=True)[1])]


def _take(code, begin, rows):
    n = begin[rows + 1] - begin[rows]
    at = np.cumsum(n) - n
    return code[np.arange(int(n.sum())) + np.repeat(begin[rows] - at, n)], np.append(at, n.sum())


def _signed(x):
    return pa.array(x.view(np.int64))


def _parts(batches, ngram):
    for batch in batches:
        for part in pieces(batch, "text", _PART):
            code, begin = sets(part.column("text"), ngram)
            yield part, code, begin, digests(code, begin)


def sketches(code: np.ndarray, n: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The fine and the coarse sketch of each set."""
    bits = np.clip(2 ** np.ceil(np.log2(np.maximum(1.5 * n, 1))).astype(np.int64), LEAST_SKETCH, MOST_SKETCH)
    size = bits // 64
    small = np.maximum(np.minimum(size, 4), size // 2)
    at, begin, first = np.append(0, np.cumsum(size)), np.append(0, np.cumsum(small)), np.append(0, np.cumsum(n))
    fine, coarse = np.zeros(at[-1], np.int64), np.zeros(begin[-1], np.int64)
    a = 0
    while a < len(n):  # as many sets at once as have some thousands of words of sketches
        b = max(a + 1, int(np.searchsorted(at, at[a] + _SKETCHED, "right")) - 1)
        own = 64 * (at[a:b] - at[a])
        odd = np.bincount(np.repeat(own, n[a:b]) + (code[first[a] : first[b]] & np.repeat(bits[a:b] - 1, n[a:b]).astype(np.uint64)).astype(np.int64), minlength=64 * (at[b] - at[a])) & 1
        fine[at[a] : at[b]] = np.packbits(odd.astype(bool), bitorder="little").view(np.int64)
        a = b
    for w in np.unique(size).tolist():
        rows = np.flatnonzero(size == w)
        own = fine[at[rows][:, None] + np.arange(w)].reshape(len(rows), -1, small[rows[0]])
        coarse[begin[rows][:, None] + np.arange(own.shape[2])] = np.bitwise_xor.reduce(own, 1)
    lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
    return lists(at, fine), lists(begin, coarse)


def _measured(docs: DataFrame, ngram: int) -> DataFrame:
    """A row (id, text hash, n, digest, fine and coarse sketch) for each document, and rows (null, null, -count, n-gram, null, null) for n-grams of many sets."""

    def run(batches):
        names, kind = ["doc_id", "t", "n", "a", "fine", "coarse"], pa.list_(pa.int64())
        for part, code, begin, d in _parts(batches, ngram):
            n = np.diff(begin)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), pa.array(n), _signed(d[0]), *sketches(code, n)], names)
            gram, count = np.unique(_take(code, begin, _once(d, n))[0], return_counts=True)
            gram, count = gram[count >= LOCAL], count[count >= LOCAL]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(gram), pa.int64()), pa.nulls(len(gram), pa.int64()), pa.array(-count), _signed(gram), pa.nulls(len(gram), kind), pa.nulls(len(gram), kind)], names)

    return docs.mapInArrow(lean(run), "doc_id long, t long, n long, a long, fine array<long>, coarse array<long>")


def _within(known: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which are in a sorted array."""
    return known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own if len(known) and len(own) else np.zeros(len(own), bool)


def _prefixes(docs: DataFrame, frequent, crowded, ngram: int, percent: int) -> DataFrame:
    """(token, a, n, i, hot), i the place in the order, for the prefix of each set: its first n - ceil(percent n) + 1 n-grams, those that aren't frequent before the others; hot: frequent or crowded."""

    def run(batches):
        known, many = frequent.value, crowded.value
        for _, code, begin, d in _parts(batches, ngram):
            rows = _once(d, np.diff(begin))
            own, begin = _take(code, begin, rows)
            late = _within(known, own)
            n = np.diff(begin)
            size = n - (n * percent + 99) // 100 + 1
            early = np.append(0, np.cumsum(~late))
            place = early[1:] - np.repeat(early[begin[:-1]], n)  # among the early ones of the row
            first = early[begin[1:]] - early[begin[:-1]]
            after = np.arange(1, len(own) + 1) - np.repeat(begin[:-1], n) - place  # among the late ones
            pick = np.flatnonzero(np.where(late, after <= np.repeat(size - first, n), place <= np.repeat(size, n)))
            row = np.repeat(np.arange(len(rows)), n)[pick]
            at = np.where(late, np.repeat(first, n) + after, place)[pick] - 1
            yield pa.RecordBatch.from_arrays([_signed(own[pick]), _signed(d[0][rows][row]), pa.array(n[row].astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(late[pick] | _within(many, own[pick]))], ["token", "a", "n", "i", "hot"])

    return docs.mapInArrow(lean(run), "token long, a long, n int, i int, hot boolean")


def _shared(keys: DataFrame, store) -> DataFrame:
    """The distinct rows of prefix n-grams that two sets have, with k, how many have it, rank, from 1, and the first one's x, nx and ix; i2: the second's i, or something less."""
    salt = F.when(F.col("hot"), F.pmod("a", F.lit(SALTS))).otherwise(0)
    order = Window.partitionBy("token", "salt").orderBy("i", "a")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = keys.withColumn("salt", salt).withColumn("before", F.lag("a").over(order)).where("before is null or before != a")
    me = F.struct("i", "a", "n")
    rows = rows.select("token", "a", "n", "i", "hot", F.count("*").over(whole).alias("k"), F.row_number().over(order).alias("rank"), F.first(me).over(order).alias("p"), F.nth_value("i", 2).over(whole).alias("i2"))
    rows = store(rows.where("hot or k > 1"))
    names = ["token", "a", "n", "i", "k", "rank", "x", "nx", "ix", "i2"]
    cold = rows.where("not hot").selectExpr("token", "a", "n", "i", "k", "rank", "p.a AS x", "p.n AS nx", "p.i AS ix", "i2")
    hot = rows.where("hot").select("token", "a", "n", "i")
    first = hot.groupBy("token").agg(F.count("*").alias("k"), F.min(me).alias("p")).where("k > 1")
    drawn = "2 + CAST(floor((k - 1) * (xxhash64(a) / 18446744073709551616D + 0.5D)) AS BIGINT)"
    hot = hot.join(first, "token").selectExpr("token", "a", "n", "i", "k", f"CASE WHEN a = p.a THEN 1 ELSE {drawn} END AS rank", "p.a AS x", "p.n AS nx", "p.i AS ix", "p.i AS i2")
    return cold.select(*names).unionByName(hot.select(*names))


def _segments(docs: DataFrame, left: np.ndarray, right: np.ndarray, ngram: int) -> DataFrame:
    """(a, doc_id, left, right, fragment, n-grams) for the documents that either side's filter lets through; the others aren't read further."""
    cut = np.array([k << 64 >> FRAGMENTS.bit_length() - 1 for k in range(1, FRAGMENTS)], np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast((left, right))

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            sides = np.stack([_passes(f, ids) for f in sent.value])
            some = np.flatnonzero(sides.any(0))
            wanted = batch.take(pa.array(some))
            at = 0
            for part, code, begin, d in _parts([wanted], ngram):
                for a in range(0, part.num_rows, 256):
                    rows = np.arange(a, min(a + 256, part.num_rows))
                    own, first = _take(code, begin, rows)
                    ends = np.stack([np.searchsorted(own[x:y], cut) + x for x, y in zip(first[:-1], first[1:], strict=True)]).reshape(len(rows), -1)
                    begins = np.column_stack([first[:-1], ends]).ravel()
                    grams = pa.ListArray.from_arrays(pa.array(np.append(begins, len(own)), pa.int32()), _signed(own))
                    each = lambda x: pa.array(np.repeat(x, FRAGMENTS))
                    place = some[at + rows]
                    yield pa.RecordBatch.from_arrays([each(d[0][rows].view(np.int64)), each(ids[place]), each(sides[0, place]), each(sides[1, place]), pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(rows))), grams], ["a", "doc_id", "left", "right", "fragment", "grams"])
                at += part.num_rows

    return docs.select("doc_id", "text").mapInArrow(lean(run), "a long, doc_id long, left boolean, right boolean, fragment int, grams array<long>")


def _passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    k = mix(ids.view(np.uint64).copy()) & np.uint64(len(bits) * 8 - 1)
    return ((bits[(k >> np.uint64(3)).astype(np.int64)] >> (k & np.uint64(7)).astype(np.uint8)) & 1) == 1


def _filter(ids: DataFrame) -> np.ndarray:
    """A bitmap with those of the ids, 16 bits for each of them but no more than MOST_FILTER_BITS; at most a 64th as many rows come to the driver."""
    size = 1 << max(16, min((16 * ids.count()).bit_length(), MOST_FILTER_BITS.bit_length() - 1))

    def run(batches):
        for batch in batches:
            k = np.unique(mix(batch.column(0).to_numpy().view(np.uint64).copy()) & np.uint64(size - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k)], ["k"])

    bit = ids.mapInArrow(lean(run), "k long")
    t = bit.groupBy(F.shiftright("k", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[t["w"].to_numpy()] = t["bits"].to_numpy()
    return out.view(np.uint8)


def _many(rows: DataFrame, n: int) -> DataFrame:
    """Rows of written tables, n of them, marked for a merge join if that is many: Spark goes by the files' bytes, so it would take millions for few and send them through the driver."""
    return rows.hint("merge") if n > MOST_SENT else rows


def components(edges: DataFrame, store) -> DataFrame:
    """(v, c) for each vertex of the edges (x, y): c is the smallest vertex that reaches v. Rounds of minimum and pointer jump, each written."""
    both = store(edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = store(both.groupBy(F.col("x").alias("v")).agg(F.least(F.min("y"), F.first("x")).alias("c")))
    n = labels.count()
    labels = _many(labels, n)
    while True:
        near = both.join(labels, F.col("y") == F.col("v")).groupBy("x").agg(F.min("c").alias("m"))
        low = labels.join(near, F.col("v") == F.col("x")).select("v", "c", F.least("c", "m").alias("low"))
        up = labels.select(F.col("v").alias("low"), F.col("c").alias("top"))
        new = store(low.join(up, "low").select("v", F.col("c").alias("old"), F.least("low", "top").alias("c")))
        labels = _many(new.select("v", "c"), n)
        if new.where("old != c").isEmpty():
            return labels


def _frequent(counted: DataFrame, least: int) -> np.ndarray:
    """The most frequent n-grams of (gram, c), MOST_FREQUENT at most and c >= least, sorted."""
    grams, total = counted.where(F.col("c") >= least), 0
    for r in sorted(grams.groupBy(F.floor(F.log2("c")).alias("l")).count().collect(), reverse=True):
        total += r["count"]
        if total > MOST_FREQUENT:
            least = 2 ** (r["l"] + 1)
            break
    return np.sort(grams.where(F.col("c") >= least).select("gram").toArrow()["gram"].to_numpy().view(np.uint64))


def _apart(percent: int):
    """Whether the sketches, sx and sy, leave room for a link; of two sizes, the larger is folded."""
    size = "least(size(sx), size(sy))"
    folded = lambda v: f"zip_with(slice({v}, 1, {size}), slice({v}, {size} + 1, {size}), (p, q) -> p ^ coalesce(q, 0L))"
    return F.expr(f"{100 + percent} * aggregate(zip_with({folded('sx')}, {folded('sy')}, (p, q) -> bit_count(p ^ q)), 0, (m, v) -> m + v) <= {100 - percent} * (nx + ny)")


def _close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y, nx, ny) that can link by their fine sketches, with the documents (dx, dy) that stand for them."""
    own = classes.select("a", "p.doc", "p.fine")
    both = pairs.join(own.toDF("x", "dx", "sx"), "x").join(own.toDF("y", "dy", "sy"), "y")
    return both.where(_apart(percent)).select("x", "y", "nx", "ny", "dx", "dy")


def _links(docs: DataFrame, both: DataFrame, ngram: int, percent: int, store) -> DataFrame:
    """Those of close pairs whose overlap, summed over the fragments, is large enough."""
    s = store(_segments(docs, _filter(both.select("dx")), _filter(both.select("dy")), ngram))
    left, right = (s.where(side).select(F.col("a").alias(v), F.col("doc_id").alias(f"d{v}"), "fragment", F.col("grams").alias(f"g{v}")) for v, side in zip("xy", ("left", "right"), strict=True))
    cut = _many(both.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1)))), FRAGMENTS * both.count())
    met = cut.join(left, ["x", "dx", "fragment"]).join(right, ["y", "dy", "fragment"])
    part = met.select("x", "y", "nx", "ny", "fragment", F.size(F.array_intersect("gx", "gy")).cast("long").alias("overlap"))
    # a row that stands twice in documents meets twice
    summed = part.groupBy("x", "y", "nx", "ny", "fragment").agg(F.max("overlap").alias("overlap")).groupBy("x", "y", "nx", "ny").agg(F.sum("overlap").alias("both"))
    return summed.where(f"100 * both >= {percent} * (nx + ny - both)").select("x", "y")


def linked(documents: DataFrame, *, ngram: int = NGRAM, percent: int = PERCENT, text: str = "text", doc: str = "doc_id", detail: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of documents; with detail also text_hash (xxhash64) and component, a number that rows share if links join them.

    Two documents link when 100 * intersection >= percent * union of their sets of word n-grams (words between ASCII blanks, A-Z
    lower-cased); one of fewer words has one n-gram, all of it; one without words, or null, has none and links with nothing (its component is null).
    component_id is the smallest doc_id that links reach, a null one counting as the smallest; rows that share a doc_id are told
    apart by their texts. Repeated rows each give a row; a very long text is a part of its own; no rows give none; other columns are not read.
    """
    spark = documents.sparkSession
    store = scratch(spark)
    docs = documents.select(F.coalesce(column(doc).cast("long"), F.lit(_NULL)).alias("doc_id"), F.xxhash64(column(text).cast("string")).alias("t"), column(text).cast("string").alias("text"))
    measured = store(_measured(docs, ngram))
    own = measured.where("n >= 0")
    classes = store(own.where("n > 0").groupBy("a", "n").agg(F.min(F.struct(F.col("doc_id").alias("doc"), "fine", "coarse")).alias("p")))
    classes = _many(classes, classes.count())
    send = spark.sparkContext.broadcast
    common = _frequent(measured.where("n < 0").groupBy(F.col("a").alias("gram")).agg(F.sum(-F.col("n")).alias("c")), FREQUENT)
    sent = send(common)
    # an n-gram may be in a few sets of each part, and in very many in all
    counted = _prefixes(docs, sent, send(common[:0]), ngram, percent).where("not hot").groupBy(F.col("token").alias("gram")).agg(F.count("*").alias("c"))
    shared = _shared(_prefixes(docs, sent, send(_frequent(store(counted.where(F.col("c") >= FREQUENT)), FREQUENT)), ngram, percent), store)
    # sets whose first common n-gram this is don't share what comes before it
    fits = f"100L * least(nx, ny) >= {percent}L * greatest(nx, ny) and {100 + percent}L * (ix + iy) <= {100 - percent}L * (nx + ny)"
    pairs = shared.selectExpr("x", "nx", "ix", "a AS y", "n AS ny", "i AS iy").where("x != y").where(fits).select("x", "y", "nx", "ny").distinct()
    checked = store(_close(pairs, classes, percent))
    edges = store(_links(docs, checked, ngram, percent, store))
    labels = components(edges, store)
    # each group's first member has met all others; of the rest, those stay that can link with the second or one after it, in groups that are not in one component yet
    rest = shared.where("rank > 1 and k > 2").where(f"{100 + percent}L * (i + i2) <= {100 - percent}L * (n + n * 100L div {percent})").select("token", "a", "n", "i", "rank")
    rest = store(_labelled(rest, labels))
    open_ = rest.groupBy("token").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least != most").select("token")
    ranked = store(rest.drop("c").join(open_, "token").join(classes.select("a", "p.coarse"), "a").select("token", "a", "n", "i", "rank", "coarse"))
    last, pivots = ranked.agg(F.max("rank")).first()[0] or 0, 2
    while pivots < last:
        until = 2 * pivots if pivots == 2 else 8 * pivots
        member = _labelled(ranked.where(f"rank >= {pivots}"), labels)
        side = lambda v: member.select("token", *(F.col(c).alias(f"{d}{v}") for c, d in (("n", "n"), ("i", "i"), ("coarse", "s"), ("rank", "r"), ("c", "c"))), F.col("a").alias(v))  # noqa: B023, E731
        x, y = side("x").where(f"rx < {until}"), side("y")
        # all conditions are part of the join, so it gives out only what is close and not in one component
        later = (y.ry > x.rx) | ((y.ry == x.rx) & (y.y > x.x))
        pairs = x.join(y, (x.token == y.token) & later & (x.cx != y.cy) & F.expr(fits) & _apart(percent)).select("x", "y", "nx", "ny").distinct()
        pairs = store(_close(pairs.join(_many(checked, checked.count()), ["x", "y"], "left_anti"), classes, percent))
        if not pairs.isEmpty():
            checked = checked.unionByName(pairs)
            more = store(_links(docs, pairs, ngram, percent, store))
            if not more.isEmpty():
                edges = edges.unionByName(more)
                labels = components(edges, store)
        pivots = until
    root = _labelled(classes, labels)
    least = root.groupBy("c").agg(F.min("p.doc").alias("component_id"))
    of = root.join(least, "c").select("a", "n", "component_id", "c")
    back = lambda c: F.nullif(c, F.lit(_NULL)).alias(c)
    out = own.join(of, ["a", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("t").alias("text_hash"), F.col("c").alias("component"))
    return out.select(back("doc_id"), "n_shingles", back("component_id"), *(["text_hash", "component"] if detail else []))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with c, the label of a: that of its component, or itself."""
    return rows.join(labels.select(F.col("v").alias("a"), "c"), "a", "left").withColumn("c", F.coalesce("c", "a"))


_NULL = -(1 << 63)
