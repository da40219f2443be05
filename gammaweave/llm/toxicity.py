"""Toxicity by two class-conditional Kneser-Ney models.

The models are over the bytes of a word, each given the ORDER - 1 before it. A class has counts of its own for the n-grams
only; what it discounts goes to a distribution from the counts of both classes together, which backs off through Kneser-Ney
continuation counts. So an expression that neither class has seen often has nearly the same probability in
both, and one that is new has exactly the same. The ratio of the two probabilities then depends on the n-gram, or, where that is new,
on its context only, and two tables of ratios are all that scoring needs.

A word's evidence is the difference of its two log-likelihoods. A document's is length-normalised: the mean over its words, the mean of
what exceeds STRONG, the largest mean over WINDOW consecutive words, and the mean of its strongest words; a logistic fit on
documents that the counts haven't seen turns these into a score.

The counts are of all labelled documents, whole texts: a grouped sum, whose table grows with the input. The models are fitted to it by
joins and grouped sums, level by level, and sent out in blocks of BLOCK n-grams, each with the contexts of its n-grams. Only the
logistic fit has a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import carried, chosen, column, fold, kept_columns, label_rows, logistic, restored, sigmoid
from .shared import scratch
from .text import LETTERS, Words, lean, pieces, words

ORDER = 7
DISCOUNT, CLASS_DISCOUNT = 0.75, 2.0
#: A word's evidence counts as strong beyond this.
STRONG = 2.0
WINDOW = 24
#: The sample of the logistic fit: documents of either label.
TOXIC_DOCS, OTHER_DOCS = 2500, 5000
#: N-grams in a block of a model, blocks that a worker keeps in memory, and labels that are broadcast to the documents.
BLOCK, KEPT, MOST_LABELS = 1 << 20, 4, 1 << 20
_SHARD, FEATURES = 3 << 20, 5


def lower_words(column: pa.Array) -> Words:
    return words(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")), LETTERS, lower=False)


def grams(w: Words, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the words at index, as numbers of 8 bits a byte, word by word; and how many each word has, one more than bytes."""
    size = w.ends[index] - w.starts[index]
    total = size + ORDER  # blanks before and one after
    at = np.cumsum(total) - total
    flat = np.full(int(total.sum()) + ORDER, 0x20, np.uint64)
    own = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat[np.repeat(at + ORDER - 1, size) + own] = w.buf[np.repeat(w.starts[index], size) + own]
    code = np.zeros(len(flat) - ORDER, np.uint64)
    for k in range(ORDER):
        code = (code << np.uint64(8)) | flat[k : k + len(code)]
    n = size + 1
    each = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return code[np.repeat(at, n) + each], n


@dataclass
class Ratios:
    """Log ratios of the two models: of n-grams, and of contexts for n-grams that are not among them."""

    gram: np.ndarray
    of_gram: np.ndarray
    context: np.ndarray
    of_context: np.ndarray

    def of(self, code: np.ndarray) -> np.ndarray:
        out = np.zeros(len(code), np.float32)
        if len(self.gram) and len(code):
            k = np.minimum(np.searchsorted(self.gram, code), len(self.gram) - 1)
            seen = self.gram[k] == code
            out[seen] = self.of_gram[k[seen]]
            rest = np.flatnonzero(~seen)
            c = code[rest] >> np.uint64(8)
            k = np.minimum(np.searchsorted(self.context, c), len(self.context) - 1)
            out[rest] = np.where(self.context[k] == c, self.of_context[k], 0)
        return out

    def words(self, w: Words, index: np.ndarray) -> np.ndarray:
        code, n = grams(w, index)
        return np.add.reduceat(self.of(code), np.cumsum(n) - n) if len(n) else np.zeros(0, np.float32)


class Blocks:
    """Ratios as broadcasts: an n-gram is in the block that its context's number names, modulo how many there are."""

    def __init__(self, sent: list):
        self.sent = sent

    def of(self, code: np.ndarray) -> np.ndarray:
        out = np.zeros(len(code), np.float32)
        if len(self.sent) == 1:
            return self.sent[0].value.of(code)
        block = (code >> np.uint64(8)) % np.uint64(max(len(self.sent), 1))
        order = np.argsort(block, kind="stable")
        ends = np.searchsorted(block[order], np.arange(len(self.sent) + 1))
        for b, sent in enumerate(self.sent):
            mine = order[ends[b] : ends[b + 1]]
            out[mine] = sent.value.of(code[mine])
            if len(self.sent) > KEPT:
                vars(sent).pop("_value", None)  # read again from the worker's disk
        return out

    words = Ratios.words


def _groups(keys: np.ndarray, values: np.ndarray):
    """Distinct sorted keys, the sums of their values, how many there are of each, and each key's place among the distinct."""
    got, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
    return got, np.bincount(inverse, values, len(got)), n, inverse


def fit_ratios(code: np.ndarray, counts: np.ndarray) -> Ratios:
    """code: distinct sorted n-grams; counts: of the ordinary and the toxic class, in two rows."""
    eight = np.uint64(8)
    # shared counts: of the n-grams themselves, then Kneser-Ney continuation counts down to single bytes
    levels, kind = [(code, counts.sum(0).astype(float))], code
    for order in range(ORDER - 1, 0, -1):
        kind, _, n, _ = _groups(kind & np.uint64((1 << 8 * order) - 1), np.ones(len(kind)))
        levels.append((kind, n.astype(float)))
    shared, order = None, 0
    for kind, n in reversed(levels):
        context, total, types, inverse = _groups(kind >> eight, n)
        if shared is None:
            below = np.full(len(kind), 1 / 256)
        else:
            below = shared[1][np.searchsorted(shared[0], kind & np.uint64((1 << 8 * order) - 1))]
        shared, order = (kind, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * types[inverse] * below) / total[inverse]), order + 1
    below, of_gram, of_context, context = shared[1], np.zeros(len(code)), 0, None
    for sign, c in ((-1, counts[0]), (1, counts[1])):
        context, total, _, inverse = _groups(code >> eight, c)
        known = total > 0
        lam = np.where(known, np.bincount(inverse, np.minimum(c, CLASS_DISCOUNT), len(context)) / np.maximum(total, 1), 1.0)
        top = np.where(known[inverse], np.maximum(c - CLASS_DISCOUNT, 0) / np.maximum(total[inverse], 1), 0)
        of_gram += sign * np.log(top + lam[inverse] * below)
        of_context = of_context + sign * np.log(lam)
    return Ratios(code, of_gram.astype(np.float32), context, of_context.astype(np.float32))


def evidence(w: Words, ratios: Ratios | Blocks) -> np.ndarray:
    """Of each row: mean log ratio of its words, largest mean of WINDOW words, means of its 1 and 3 strongest distinct words; zeros without words."""
    rows = len(w.first) - 1
    out = np.zeros((rows, FEATURES))
    if not len(w):
        return out
    _, index, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
    v = ratios.words(w, index)[inverse].astype(float)
    some = np.flatnonzero(w.counts())
    at, n = w.first[:-1][some], w.counts()[some]
    out[some, 0] = np.add.reduceat(v, at) / n
    out[some, 4] = np.add.reduceat(np.maximum(v - STRONG, 0), at) / n
    total = np.append(0, np.cumsum(v))
    end = w.first[1:][w.row]
    stop = np.minimum(np.arange(len(w)) + WINDOW, end)
    whole = (np.arange(len(w)) + WINDOW <= end) | (np.arange(len(w)) == w.first[:-1][w.row])
    mean = np.where(whole, (total[stop] - total[:-1]) / np.maximum(stop - np.arange(len(w)), 1), -np.inf)
    out[some, 1] = np.maximum.reduceat(mean, at)
    best, top = v.copy(), []
    for _ in range(3):
        top.append(np.maximum(np.maximum.reduceat(best, at), 0))
        best[best >= np.repeat(top[-1], n)] = -np.inf
    out[some, 2], out[some, 3] = top[0], (top[0] + top[1] + top[2]) / 3
    return out


@dataclass
class Model:
    ratios: Blocks
    fit: tuple

    def scores(self, w: Words) -> np.ndarray:
        mean, scale, b = self.fit
        return sigmoid(((evidence(w, self.ratios) - mean) / scale) @ b[:-1] + b[-1])


def _counted(docs: DataFrame) -> DataFrame:
    """(code, n0, n1, n2, n3): how often each n-gram is in the ordinary documents of either half, and in the toxic ones, over whole texts."""

    def merged(parts):
        code, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        n = np.concatenate([n for _, n in parts], axis=1)
        return code, np.stack([np.bincount(inverse, row, len(code)).astype(np.int64) for row in n])

    def rows(code, n):
        return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), *(pa.array(row) for row in n)], ["code", "n0", "n1", "n2", "n3"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for part in pieces(batch, "text", _SHARD):
                kind = part.column("label").to_numpy(zero_copy_only=False) * 2 + part.column("half").to_numpy(zero_copy_only=False)
                w = lower_words(part.column("text"))
                if not len(w):
                    continue
                _, index, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
                seen = np.stack([np.bincount(inverse[kind[w.row] == k], minlength=len(index)) for k in range(4)])
                code, n = grams(w, index)
                parts.append((code, np.repeat(seen, n, axis=1)))
                held += len(code)
                if held > 1 << 20:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > 1 << 19:
                        yield rows(*parts[0])
                        parts, held = [], 0
        if parts:
            yield rows(*merged(parts))

    t = docs.mapInArrow(lean(run), "code long, n0 long, n1 long, n2 long, n3 long")
    return t.groupBy("code").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "n2", "n3")))


def _fitted(counts: DataFrame, models: list[tuple[int, ...]], store) -> tuple[DataFrame, DataFrame]:
    """(code, r0, r1, ...) and (context, r0, r1, ...): what fit_ratios gives for each model, a tuple of halves; null where the model lacks the n-gram."""
    each = range(len(models))
    of_class = lambda c, m: sum((F.col(f"n{2 * c + h}") for h in models[m]), F.lit(0))
    level = counts.select("code", *(of_class(c, m).cast("double").alias(f"c{c}{m}") for c in (0, 1) for m in each))
    level = store(level.select("*", *((F.col(f"c0{m}") + F.col(f"c1{m}")).alias(f"n{m}") for m in each)))
    levels = [level]
    for order in range(ORDER - 1, 0, -1):
        shorter = levels[-1].select(F.col("code").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("code"), *(F.col(f"n{m}") for m in each))
        levels.append(store(shorter.groupBy("code").agg(*(F.sum((F.col(f"n{m}") > 0).cast("double")).alias(f"n{m}") for m in each))))
    below = None
    context = F.shiftright("code", 8)
    for order, level in enumerate(reversed(levels), 1):
        sums = [x for m in each for x in (F.sum(f"n{m}").alias(f"t{m}"), F.sum((F.col(f"n{m}") > 0).cast("double")).alias(f"k{m}"))]
        if order == ORDER:
            sums += [x for m in each for c in (0, 1) for x in (F.sum(f"c{c}{m}").alias(f"t{c}{m}"), F.sum(F.least(f"c{c}{m}", F.lit(CLASS_DISCOUNT))).alias(f"d{c}{m}"))]
        of = level.groupBy(context.alias("context")).agg(*sums)
        met = level.withColumn("context", context).join(of, "context")
        if below is None:
            met = met.select("*", *(F.lit(1 / 256).alias(f"b{m}") for m in each))
        else:
            met = met.withColumn("tail", F.col("code").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))).join(below.withColumnRenamed("code", "tail"), "tail")
        p = lambda m: F.when(F.col(f"n{m}") > 0, F.expr(f"(greatest(n{m} - {DISCOUNT}D, 0D) + {DISCOUNT}D * k{m} * b{m}) / t{m}"))
        if order < ORDER:
            below = store(met.select("code", *(p(m).alias(f"b{m}") for m in each)))
    lam = lambda c, m: F.when(F.col(f"t{c}{m}") > 0, F.col(f"d{c}{m}") / F.greatest(f"t{c}{m}", F.lit(1.0))).otherwise(1.0)
    top = lambda c, m: F.when(F.col(f"t{c}{m}") > 0, F.greatest(F.col(f"c{c}{m}") - CLASS_DISCOUNT, F.lit(0.0)) / F.greatest(f"t{c}{m}", F.lit(1.0))).otherwise(0.0)
    met = met.select("*", *(p(m).alias(f"p{m}") for m in each))
    gram = met.select("code", *((F.log(top(1, m) + lam(1, m) * F.col(f"p{m}")) - F.log(top(0, m) + lam(0, m) * F.col(f"p{m}"))).cast("float").alias(f"r{m}") for m in each))
    contexts = of.select("context", *(F.when(F.col(f"t{m}") > 0, F.log(lam(1, m)) - F.log(lam(0, m))).cast("float").alias(f"r{m}") for m in each))
    return store(gram), store(contexts)


def _blocks(gram: DataFrame, contexts: DataFrame, models: int) -> list[Blocks]:
    """The models in blocks; one block at a time comes to the driver."""
    count = -(-gram.count() // BLOCK) | 1
    send, out = gram.sparkSession.sparkContext.broadcast, [[] for _ in range(models)]

    def table(rows, key, number, b):
        t = (rows.where(F.pmod(number, F.lit(count)) == b) if count > 1 else rows).toArrow()
        k = t[key].to_numpy().astype(np.uint64)
        order = np.argsort(k)
        k, found = k[order], []
        for m in range(models):
            r = t[f"r{m}"].to_numpy().astype(np.float32)[order]
            found.append((k[~np.isnan(r)], r[~np.isnan(r)]))
        return found

    for b in range(count):
        for m, (g, c) in enumerate(zip(table(gram, "code", F.shiftright("code", 8), b), table(contexts, "context", F.col("context"), b), strict=True)):
            out[m].append(send(Ratios(*g, *c)))
    return [Blocks(x) for x in out]


def train(documents: DataFrame, labels: DataFrame, *, label: str = "toxic", text: str = "text", doc: str = "doc_id", use=None,
          toxic_docs: int = TOXIC_DOCS, other_docs: int = OTHER_DOCS) -> Model:
    """Counts n-grams over all labelled documents, and fits the score on at most toxic_docs and other_docs of them (those with the smallest hash of their id).

    use: a condition on labels' doc_id that learning is held to. Null ids and labels are left out, of several labels of an id the largest counts; null texts are empty, whole
    texts count however long, repeated rows each; ties in the sample go by id. Without labelled texts of both kinds, all scores are the share of toxic labels.
    """
    store = scratch(documents.sparkSession)
    rows = label_rows(labels, label, doc)
    rows = rows if use is None else rows.where(use)
    share = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    texts = documents.select(column(doc).alias("doc_id"), column(text).cast("string").alias("text"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int").alias("half")
    labelled = texts.join(F.broadcast(rows) if sum(share.values()) <= MOST_LABELS else rows, "doc_id").select("label", "text", half)
    counts = store(_counted(labelled))
    rate = (share.get(1, 0) + 0.5) / (sum(share.values()) + 1)
    found = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n0", "n1", "n2", "n3"))).first()
    if not (found[0] + found[1] and found[2] + found[3]):
        return Model(Blocks([]), (np.zeros(FEATURES), np.ones(FEATURES), np.append(np.zeros(FEATURES), np.log(rate / (1 - rate)))))
    models = [(0, 1), (0,), (1,)] if all(found) else [(0, 1)]
    ratios = _blocks(*_fitted(counts, models, store), len(models))
    unseen = (ratios[2], ratios[1]) if all(found) else (ratios[0], ratios[0])
    sample = chosen(rows, [1, 0], {1: toxic_docs, 0: other_docs})
    docs = texts.join(F.broadcast(sample), "doc_id").select("label", "text", half)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", _SHARD):
                for h in (0, 1):
                    mine = part.filter(pc.equal(part.column("half"), h))
                    x = evidence(lower_words(mine.column("text")), unseen[h])
                    yield pa.RecordBatch.from_arrays([mine.column("label"), *(pa.array(c) for c in x.T)], ["label", *"abcde"])

    t = docs.mapInArrow(lean(run), "label int, a double, b double, c double, d double, e double").toArrow()
    y = t["label"].to_numpy().astype(float)
    x = np.column_stack([t[c].to_numpy() for c in "abcde"])
    # the classes weigh as they do among all labels, not as in the sample
    weight = np.where(y == 1, rate / max(y.mean(), 1e-9), (1 - rate) / max(1 - y.mean(), 1e-9))
    return Model(ratios[0], logistic(x, y, weight))


def score(documents: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """documents' columns keep and out, a score from 0 to 1. Whole texts; a null or wordless text has the score of no evidence.

    Repeated rows each give a row and equal scores, no rows give none, a very long text is one part of its own, and columns not in keep are not
    read; one of keep named as out gets _ at its end.
    """
    docs, read = kept_columns(documents, keep, text)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, read, _SHARD):
                own = model.scores(lower_words(part.column(read)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried(keep)), pa.array(own)], [*carried(keep), "score"])

    schema = docs.select(*carried(keep), F.lit(None).cast("double").alias("score")).schema
    return restored(docs.mapInArrow(lean(run), schema).withColumnRenamed("score", out), keep, out)


def held_out(doc: str = "doc_id"):
    return fold(F.col(doc), 5) == 0
