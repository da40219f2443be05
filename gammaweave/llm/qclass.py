"""Quality classifier: histogram gradient-boosted trees over statistics of a text.

The statistics of a whole Arrow batch are a few numpy passes over its bytes. The trees are fitted on the driver to a bounded sample of
labelled documents, and flattened into arrays; scoring moves all rows of a batch down one level of a tree at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import _sorted
from .sampling import carried, chosen, column, fold, kept_columns, label_rows, restored, sigmoid
from .text import NONBLANK, buffers, lean, pieces, words

#: The sample that is learned from: documents of each label. Only their statistics come to the driver, so texts of any length are learned from.
DOCS_PER_LABEL = 6000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_LEAF = 80, 4, 64, 0.15, 2.0, 8
_SHARD = 4 << 20
_CLASSES = ["upper", "lower", "digit", "beyond", "symbol", "stop", "newline", "other"]


def _class(b: int) -> int:
    c = chr(b)
    return 3 if b >= 128 else 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 4 if c in "#*$%&|<>!@^~=+_/\\{}[]" else 5 if c in ".,;:?" else 6 if c == "\n" else 7


_CLASS = np.array([_class(b) for b in range(256)], np.uint8)
_LINE = np.array([b != 10 for b in range(256)])
FEATURES = [*(f"share_{c}" for c in _CLASSES), "log_words", "word_bytes", "distinct_words", "same_as_before", "same_as_two_before", "odd_ends", "all_upper", "log_lines", "line_bytes", "distinct_lines", "repeated_grams"]


def _distinct(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(_sorted(h.copy(), first)[1])


def statistics(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; all zero for a null or empty one."""
    rows = len(column)
    out = np.zeros((rows, len(FEATURES)))
    buf, offsets = buffers(column, False)
    size = np.maximum(np.diff(offsets), 1)
    kind = _CLASS[buf]
    for k in range(len(_CLASSES)):
        total = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(kind == k, out=total[1:])
        out[:, k] = np.diff(total[offsets]) / size
    w = words(column, NONBLANK, lower=False)
    n = np.maximum(w.counts(), 1)
    h = w.hashes()
    out[:, 8] = np.log1p(w.counts())
    out[:, 9] = np.bincount(w.row, w.ends - w.starts, rows) / n
    out[:, 10] = _distinct(h, w.first) / n
    for k, f in ((1, 11), (2, 12)):
        same = np.zeros(len(h), bool)
        same[k:] = (h[k:] == h[:-k]) & (w.row[k:] == w.row[:-k])
        out[:, f] = np.bincount(w.row, same, rows) / n
    if len(w):
        last = kind[w.ends - 1]
        out[:, 13] = np.bincount(w.row, last == 4, rows) / n
        cased = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(kind == 1, out=cased[1:])
        out[:, 14] = np.bincount(w.row, (cased[w.ends] == cased[w.starts]) & (kind[w.starts] == 0) & (w.ends - w.starts > 1), rows) / n
    lines = words(column, _LINE, lower=False)
    m = np.maximum(lines.counts(), 1)
    out[:, 15] = np.log1p(lines.counts())
    out[:, 16] = np.log1p(np.bincount(lines.row, lines.ends - lines.starts, rows) / m)
    out[:, 17] = _distinct(lines.hashes(), lines.first) / m
    if len(h) > 3:
        gram = h[:-3] * np.uint64(3) + h[1:-2] * np.uint64(5) + h[2:-1] * np.uint64(7) + h[3:] * np.uint64(11)
        whole = w.row[3:] == w.row[:-3]
        gram, row = gram[whole], w.row[:-3][whole]
        first = np.searchsorted(row, np.arange(rows + 1))
        out[:, 18] = 1 - _distinct(gram, first) / np.maximum(np.diff(first), 1)
    return out


@dataclass
class Trees:
    """All trees' nodes one after another; a leaf is its own child on both sides."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return sigmoid(total)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Boosted logistic trees, each grown level by level on histograms of gradients."""
    rate = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    bins = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)]) if len(x) else np.zeros(x.shape, int)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots, f = [], np.full(len(y), base)
    width = BINS * x.shape[1]
    for _ in range(TREES if len(y) and 0 < y.mean() < 1 else 0):
        p = sigmoid(f)
        g, h = weight * (p - y), weight * p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
        at, level = np.full(len(y), roots[-1]), [roots[-1]]
        for _ in range(DEPTH):
            place = {k: i for i, k in enumerate(level)}
            inside = np.isin(at, level)
            of = np.array([place.get(k, 0) for k in range(roots[-1], len(nodes))])[at[inside] - roots[-1]]
            flat = (of[:, None] * width + np.arange(x.shape[1]) * BINS + bins[inside]).ravel()
            G, H, C = (np.bincount(flat, np.repeat(v[inside], x.shape[1]), len(level) * width).reshape(len(level), x.shape[1], BINS).cumsum(2) for v in (g, h, np.ones(len(y))))
            g0, h0, c0 = G[:, :, -1:], H[:, :, -1:], C[:, :, -1:]
            gain = G**2 / (H + RIDGE) + (g0 - G) ** 2 / (h0 - H + RIDGE) - g0**2 / (h0 + RIDGE)
            gain[(C < LEAST_LEAF) | (c0 - C < LEAST_LEAF)] = -np.inf
            new = []
            for i, k in enumerate(level):
                j, b = divmod(int(np.argmax(gain[i])), BINS)
                if gain[i, j, b] > 1e-6 and b < len(edges[j]):
                    nodes[k][:4] = [j, float(edges[j][b]), len(nodes), len(nodes) + 1]
                    mine = at == k
                    at[mine] = np.where(bins[mine, j] <= b, len(nodes), len(nodes) + 1)
                    for _ in range(2):
                        new.append(len(nodes))
                        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
            level = new
            if not level:
                break
        local = at - roots[-1]
        size = len(nodes) - roots[-1]
        value = -RATE * np.bincount(local, g, size) / (np.bincount(local, h, size) + RIDGE)
        for k in range(size):
            nodes[roots[-1] + k][4] = float(value[k])
        f += value[local]
    c = list(zip(*nodes, strict=True)) if nodes else [[], [], [], [], []]
    return Trees(base, np.array(roots, int), np.array(c[0], int), np.array(c[1], float), np.array(c[2], int), np.array(c[3], int), np.array(c[4], float))


def train(documents: DataFrame, labels: DataFrame, *, label: str = "quality", text: str = "text", doc: str = "doc_id", use=None, per_label: int = DOCS_PER_LABEL) -> Trees:
    """Fits on the whole texts of at most per_label documents of each label (smallest hash of the id, ties by the id); use is a condition on doc_id.

    Null ids and labels are left out; a null text counts as empty; a document that stands twice is learned from twice. Without labels of both kinds there are no trees.
    """
    rows = label_rows(labels, label, doc)
    rows = rows if use is None else rows.where(use)
    share = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    sample = chosen(rows, [1, 0], {1: per_label, 0: per_label})
    docs = documents.select(column(doc).alias("doc_id"), column(text).cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", _SHARD):
                x = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), *(pa.array(c) for c in x.T)], ["doc_id", "label", *FEATURES])

    t = docs.select("doc_id", "label", "text").mapInArrow(lean(run), "doc_id long, label int, " + ", ".join(f"{f} double" for f in FEATURES)).toArrow().sort_by([("doc_id", "ascending"), (FEATURES[9], "ascending")])
    y = t["label"].to_numpy().astype(float)
    rate = (share.get(1, 0) + 0.5) / (sum(share.values()) + 1)
    # the classes weigh as they do among all labels, not as in the sample
    weight = np.where(y == 1, rate / max(y.mean(), 1e-9), (1 - rate) / max(1 - y.mean(), 1e-9)) if len(y) else y
    return fit(np.column_stack([t[f].to_numpy() for f in FEATURES]), y, weight)


def score(documents: DataFrame, model: Trees, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """documents' columns keep and score, 0 to 1, of whole texts.

    A null or empty text has all statistics zero and is scored as such; a very long text is one part of its own; rows of equal texts get equal
    scores, each row its own; no rows give none; columns not in keep are not read, and one of them named score becomes score_. Without labels of both kinds all scores are equal.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    docs, read = kept_columns(documents, keep, text)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, read, _SHARD):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried(keep)), pa.array(sent.value.scores(statistics(part.column(read))))], [*carried(keep), "score"])

    schema = docs.select(*carried(keep), F.lit(None).cast("double").alias("score")).schema
    return restored(docs.mapInArrow(lean(run), schema), keep, "score")


def held_out(doc: str = "doc_id"):
    return fold(F.col(doc), 5) == 0
