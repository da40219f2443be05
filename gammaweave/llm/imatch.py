"""I-Match fingerprints of documents: terms within a band of inverse document frequency, sorted, and hashed over randomised subsets of the lexicon.

The lexicon has the words whose document frequency, of all documents counted, lies between 1/4096 and 1/64: idf = ln(documents / frequency) within MIN_IDF and MAX_IDF. It holds at
most e^MAX_IDF times the mean number of a document's distinct words, however many documents there are; the bound is checked before it is sent to the tasks.

A term's hash deals it into one of SUBSETS random subsets, and gives it a random number; the subset's lexicon at level l keeps the terms whose number is among the smallest 2^-l.
A document of n distinct terms is at the level where n / 2^l is less than SUBSETS, so a subset holds about one of its terms, as one changed term changes the whole subset's hash.
The fingerprint has the level, and the hash of the sorted terms in each subset at this level and the next. The likeness of two is the share of equal hashes, of
the subsets that either has terms in, at the deeper level of both: with about a term a subset it follows the share of common terms. Levels that differ by more than one have likeness 0.
"""

from __future__ import annotations

import hashlib
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import column
from .shared import scratch
from .text import ALNUM, lean, mix, pieces, words

MIN_IDF, MAX_IDF = log(64), log(4096)
#: Fewer terms in the band than these, and all of the document's words count; terms that are sent to a task at most.
FEW, MOST_TERMS = 8, 1 << 23
SUBSETS, LEVELS, EMPTY = 64, 2, 0xFFF
#: Bits of a term: its subset, then its number.
SUBSET_BITS, NUMBER_BITS = 6, 38
PIECE = 4 << 20
#: Bytes of texts in a range of documents, and ranges at most.
RANGE, MOST_RANGES = 4 << 20, 20_000
#: Ids looked at for each range's borders.
LOOKS = 64
_CODES = np.frombuffer("".join(f"{x:03x}" for x in range(EMPTY)).encode() + b"...", np.uint8).reshape(EMPTY + 1, 3)


def _keys(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Distinct (row, term) as one number each, sorted by row, subset and number."""
    bits = np.uint64(SUBSET_BITS + NUMBER_BITS)
    return np.unique((row.astype(np.uint64) << bits) | (h >> (np.uint64(64) - bits)))


def frequencies(documents: DataFrame, text: str = "text") -> DataFrame:
    """h and n: of each word's hash the number of documents that have it; and one row of null h with the documents in n and their bytes in size."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                w = words(piece.column("text"), ALNUM)
                h = w.hashes()
                order = np.argsort(h, kind="stable")  # of one word, the rows stay in order
                h, row = h[order], w.row[order]
                own = h[np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])] if len(h) else h
                kinds, n = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(kinds.view(np.int64))]), pa.array(np.append(piece.num_rows, n)), pa.array(np.append(len(w.buf), np.zeros(len(n), np.int64)))],
                    ["h", "n", "size"],
                )

    rows = documents.select(column(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "h long, n long, size long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))


def lexicon(counted: DataFrame, min_idf: float = MIN_IDF, max_idf: float = MAX_IDF) -> tuple[np.ndarray, int, int]:
    """The sorted hashes of the words within the band, and the number of documents and their bytes, of what frequencies() gives. Up to 128 documents words of two still count."""
    whole = counted.where("h is null").first()
    n, size = (whole["n"], whole["size"]) if whole else (0, 0)
    inside = counted.where(F.col("h").isNotNull() & (F.col("n") >= n * exp(-max_idf)) & (F.col("n") <= max(2.0, n * exp(-min_idf)))).select("h")
    if inside.count() > MOST_TERMS:
        raise ValueError("too many terms for one broadcast; take a smaller max_idf")
    return np.sort(inside.toArrow().column("h").to_numpy().view(np.uint64)), n, size


class Prints:
    """Fingerprints of some texts: levels (-1 without any word), hashes by level and subset, and the texts' own hashes for those without words."""

    def __init__(self, texts: pa.Array, terms: np.ndarray):
        w = words(texts, ALNUM)
        n, h = len(texts), w.hashes()
        at = np.minimum(np.searchsorted(terms, h), max(len(terms) - 1, 0))
        inside = terms[at] == h if len(terms) else np.zeros(len(h), bool)
        bits = np.uint64(SUBSET_BITS + NUMBER_BITS)
        keys = _keys(w.row[inside], h[inside])
        few = np.bincount((keys >> bits).astype(np.int64), minlength=n) < FEW
        if few.any():
            rest = few[w.row]
            keys = np.union1d(keys[~few[(keys >> bits).astype(np.int64)]], _keys(w.row[rest], h[rest]))
        row = (keys >> bits).astype(np.int64)
        count = np.bincount(row, minlength=n)
        self.level = np.where(count > 0, np.maximum(np.floor(np.log2(np.maximum(count, 1) * 2 / SUBSETS)), 0), -1).astype(np.int64)
        self.hashes = np.full((n, LEVELS, SUBSETS), EMPTY, np.uint16)
        if len(keys):
            group = (keys >> np.uint64(NUMBER_BITS)).astype(np.int64)
            begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            place = np.arange(len(keys)) - np.repeat(begins, np.diff(np.append(begins, len(keys))))
            number = keys & np.uint64((1 << NUMBER_BITS) - 1)
            value = mix(keys & np.uint64((1 << (SUBSET_BITS + NUMBER_BITS)) - 1)) * (2 * place.astype(np.uint64) + np.uint64(1))
            for k in range(LEVELS):
                kept = number < (np.uint64(1) << (NUMBER_BITS - np.minimum(self.level[row] + k, NUMBER_BITS)).astype(np.uint64))
                some = np.logical_or.reduceat(kept, begins)
                total = mix(np.add.reduceat(np.where(kept, value, np.uint64(0)), begins))
                self.hashes[row[begins[some]], k, group[begins[some]] % SUBSETS] = (total[some] % np.uint64(EMPTY)).astype(np.uint16)
        self.alone = {int(i): "ff" + hashlib.sha256((texts[int(i)].as_py() or "").encode()).hexdigest() for i in np.flatnonzero(self.level < 0)}

    def strings(self) -> list[str]:
        raw = _CODES[self.hashes].reshape(len(self.level), -1).tobytes().decode()
        size = 3 * LEVELS * SUBSETS
        return [self.alone.get(i) or f"{v:02x}{raw[i * size : (i + 1) * size]}" for i, v in enumerate(self.level.tolist())]

    @staticmethod
    def of(prints: list[str]) -> Prints:
        """Read again from their strings."""
        out = Prints.__new__(Prints)
        out.level = np.array([-1 if p.startswith("ff") else int(p[:2], 16) for p in prints], np.int64)
        out.alone = {i: p for i, p in enumerate(prints) if p.startswith("ff")}
        code = lambda p: [EMPTY if p[i] == "." else int(p[i : i + 3], 16) for i in range(2, len(p), 3)]
        out.hashes = np.array([[EMPTY] * LEVELS * SUBSETS if p.startswith("ff") else code(p) for p in prints], np.uint16).reshape(-1, LEVELS, SUBSETS)
        return out


def likeness(a: Prints, i: np.ndarray, b: Prints, j: np.ndarray) -> np.ndarray:
    """Of each pair of a's and b's fingerprints, from 0 to 1; 1 for equal ones. Those of texts without words are like equal ones only."""
    la, lb = a.level[i], b.level[j]
    deep = np.maximum(la, lb)
    ok = (np.abs(la - lb) < LEVELS) & (np.minimum(la, lb) >= 0)
    x, y = (p.hashes[at, np.clip(deep - p.level[at], 0, LEVELS - 1)] for p, at in ((a, i), (b, j)))
    some = ((x != EMPTY) | (y != EMPTY)).sum(1)
    same = ((x == y) & (x != EMPTY)).sum(1)
    out = np.where(ok & (some > 0), same / np.maximum(some, 1), 0.0)
    out[ok & (some == 0) & (la == lb)] = 1.0
    for k in np.flatnonzero((la < 0) & (lb < 0)).tolist():
        out[k] = float(a.alone[int(i[k])] == b.alone[int(j[k])])
    return out


def fingerprints(documents: DataFrame, terms: np.ndarray | None = None, *, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """doc_id and fingerprint of each row of documents, made in its task; terms as lexicon() gives them for these documents, if not given.

    Equal texts have equal fingerprints. A null text is an empty one; texts with fewer than FEW terms in the band go by all of their words, and texts without words (whatever else they
    hold) by a hash of the whole text. Rows that are repeated or have no id are rows like others; no documents, no rows; other columns are not read.
    """
    terms = lexicon(scratch(documents.sparkSession)(frequencies(documents, text)))[0] if terms is None else terms
    sent = documents.sparkSession.sparkContext.broadcast(terms)  # its size is checked
    kind = documents.schema[doc].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(Prints(piece.column("text"), sent.value).strings(), pa.string())], ["doc_id", "fingerprint"])

    rows = documents.select(column(doc).alias("doc_id"), column(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id {kind}, fingerprint string")


def _dealt(documents: DataFrame, n: int, size: int) -> DataFrame:
    """doc_id, text, part and guest: the documents in ranges of ids, each range in a partition of its own, sorted; after a range's own documents, as a guest, the first of the next (after the last, of the first)."""
    spark, ids = documents.sparkSession, documents.select("doc_id")
    ranges = min(MOST_RANGES, max(1, ceil(size / RANGE)))
    every = max(1, n // (LOOKS * ranges))
    looked = [r[0] for r in ids.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)).orderBy("doc_id").collect()] if ranges > 1 else []
    bounds = sorted({looked[k * len(looked) // ranges] for k in range(1, ranges)}) if looked else []
    if bounds:
        kind = np.array(bounds).dtype if not isinstance(bounds[0], str) else object
        border = np.array(bounds, kind)

        @F.arrow_udf("int")
        def part_of(x: pa.Array) -> pa.Array:
            out = np.zeros(len(x), np.int32)  # null ids come first
            some = x.is_valid().to_numpy(zero_copy_only=False)
            out[some] = np.searchsorted(border, x.drop_null().to_numpy(zero_copy_only=False), "right")
            return pa.array(out)

        part = lambda rows: rows.withColumn("part", part_of("doc_id"))
    else:
        part = lambda rows: rows.withColumn("part", F.lit(0))
    # a row a range, so at most MOST_RANGES
    first = sorted((r["part"], r["first"]["doc_id"]) for r in part(ids).groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first")).collect())
    guests = spark.createDataFrame([(first[(k + 1) % len(first)][1], p) for k, (p, _) in enumerate(first)], f"g {ids.schema['doc_id'].dataType.simpleString()}, target int")
    both = part(documents).join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("g")), "left")
    places = "CASE WHEN target IS NULL THEN array(named_struct('part', part, 'guest', false)) ELSE array(named_struct('part', part, 'guest', false), named_struct('part', target, 'guest', true)) END"
    rows = both.selectExpr("doc_id", "text", f"inline({places})")
    return rows.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("guest", F.asc_nulls_first("doc_id"), "text")


def edited_and_next(documents: DataFrame, *, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """For each row of documents doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text is the text with its last quarter (rounded down) of code points replaced by the first as many, or all, of the next document: by ascending id, null ids
    first, of equal ids by text; after the last comes the first. near_edited and near_next are the likeness to the edited text and to the next document. The
    documents are dealt once, by ranges of ids, each with the next range's first document. An empty or null text has no characters, and is like empty texts only; a single document is its own next; no documents,
    no rows; other columns are not read. Ids are keys: a range holds all rows of an id.
    """
    rows = documents.select(column(doc).alias("doc_id"), column(text).cast("string").alias("text"))
    terms, n, size = lexicon(scratch(documents.sparkSession)(frequencies(rows)))
    sent = documents.sparkSession.sparkContext.broadcast(terms)  # its size is checked
    kind = rows.schema["doc_id"].dataType.simpleString()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def done(piece: pa.RecordBatch) -> pa.RecordBatch:
        """Of all rows but the last, each with the next one."""
        texts = piece.column("text").fill_null("")
        strings = texts.to_pylist()
        edited = [a[: len(a) - len(a) // 4] + b[: len(a) // 4] for a, b in zip(strings[:-1], strings[1:], strict=True)]
        own, other, at = Prints(texts, sent.value), Prints(pa.array(edited, pa.string()), sent.value), np.arange(len(edited))
        prints = own.strings()
        columns = {
            "doc_id": piece.column("doc_id").slice(0, len(edited)), "n_chars": pa.array([len(x) for x in strings[:-1]], pa.int64()), "edited_sha256": pa.array([sha(x) for x in edited], pa.string()),
            "fingerprint": pa.array(prints[:-1], pa.string()), "edited_fingerprint": pa.array(other.strings(), pa.string()),
            "near_edited": pa.array(likeness(own, at, other, at)), "near_next": pa.array(likeness(own, at, own, at + 1)),
        }
        return pa.RecordBatch.from_pydict(columns).filter(pa.array(~piece.column("guest").to_numpy(zero_copy_only=False)[:-1]))

    def run(batches):
        waiting = None  # the last row so far, whose next is still to come
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                piece = pa.concat_batches([waiting, piece]) if waiting is not None else piece
                waiting = piece.slice(piece.num_rows - 1)
                if piece.num_rows > 1:
                    yield done(piece)

    dealt = _dealt(rows, n, size).select("doc_id", "text", "guest")
    return dealt.mapInArrow(lean(run), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
