"""Language of words and of texts by a linear-chain conditional random field.

A word's features are itself (the lexicon), the byte n-grams in it, and its affixes, the n-grams with its first or last place;
each is hashed to one of BUCKETS weights per language. The transitions between the languages of consecutive words are
learned with them, by gradient ascent on the likelihood of code-switched training sequences: all words of the sampled documents, whose
language is known, cut into stretches in a random but repeatable order. Forward-backward then gives each word the probabilities of its languages, over the
whole text; all texts of a part take each step together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sampling import carried, column, fold, kept_columns, restored
from .text import Words, lean, mix, pieces
from .toxicity import lower_words

BUCKETS = 1 << 18
ORDERS = (2, 3, 4)
#: The sample that is learned from: documents in all, as many of each language, whole texts.
SAMPLE_DOCS = 2000
#: Languages; more are an error, as each has its weights.
MOST_LANGS = 500
#: Training sequences: words in each, most words of a stretch, sequences that a step takes, least steps, and the penalty on weights.
LENGTH, STRETCH, SEQUENCES, STEPS, PENALTY = 48, 24, 6000, 40, 1e-4
#: Parts of a language that are sorted apart when its sample is chosen.
_APART = 256
_SHARD = 4 << 20


def features(w: Words, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the features of the words at index, and where each word's begin."""
    size = w.ends[index] - w.starts[index]
    total = size + 2
    at = np.cumsum(total) - total
    flat = np.full(int(total.sum()) + max(ORDERS), 3, np.uint64)
    flat[at] = 2
    own = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat[np.repeat(at + 1, size) + own] = w.buf[np.repeat(w.starts[index], size) + own]
    word = np.repeat(np.arange(len(index)), total)
    place = np.arange(len(word)) - np.repeat(at, total)
    whole = np.zeros(len(index), np.uint64)
    codes, words_of = [], []
    for n in ORDERS:
        code = np.full(len(word), n, np.uint64)
        for k in range(n):
            code = code * np.uint64(0x100000001B3) + flat[k : k + len(word)]
        fits = place + n <= total[word]
        code = mix(code[fits])
        codes.append(code)
        words_of.append(word[fits])
        if n == ORDERS[0] and len(code):  # the lexicon's key: the word's first n-grams with their places
            weight = mix(place[fits].astype(np.uint64))
            np.add.at(whole, word[fits], code * (weight | np.uint64(1)))
    codes.append(mix(whole))
    words_of.append(np.arange(len(index)))
    code, of = np.concatenate(codes), np.concatenate(words_of)
    order = np.argsort(of, kind="stable")
    return (code[order] & np.uint64(BUCKETS - 1)).astype(np.int64), np.searchsorted(of[order], np.arange(len(index)))


def forward_backward(potential: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts whose words begin at `first` (one more than texts): each word's probabilities of its labels, and each step's scale.

    potential: exponentiated emission scores, of any scale; trans: exponentiated transition scores. Texts take their steps together.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    start, size = first[:-1][order], n[order]
    alpha, beta, scale = np.empty_like(potential), np.empty_like(potential), np.empty(len(potential))
    steps = int(size.max(initial=0))
    active = np.searchsorted(-size, -np.arange(steps), "left")  # texts longer than t
    for t in range(steps):
        at = start[: active[t]] + t
        a = potential[at] if t == 0 else (a[: active[t]] @ trans) * potential[at]
        s = a.sum(1)
        a = a / s[:, None]
        alpha[at], scale[at] = a, s
    b = np.ones((0, potential.shape[1]))
    for t in range(steps - 1, -1, -1):
        k = active[t]
        if len(b):
            follow = start[: len(b)] + t + 1
            b = (b * potential[follow]) @ trans.T / scale[follow][:, None]
        b = np.concatenate([b, np.ones((k - len(b), potential.shape[1]))]) if k > len(b) else b
        beta[start[:k] + t] = b
    both = alpha * beta
    return both / np.maximum(both.sum(1, keepdims=True), 1e-300), scale


@dataclass
class Field:
    labels: list
    weights: np.ndarray  # a row for each bucket
    trans: np.ndarray  # log scores

    def emissions(self, w: Words, index: np.ndarray) -> np.ndarray:
        code, at = features(w, index)
        return np.add.reduceat(self.weights[code], at, axis=0) if len(index) else np.zeros((0, len(self.labels)), np.float32)

    def probabilities(self, w: Words) -> np.ndarray:
        if not len(w):
            return np.zeros((0, len(self.labels)))
        _, index, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
        e = self.emissions(w, index).astype(float)
        e = np.exp(np.clip(e - e.max(1, keepdims=True), -30, 0))
        return forward_backward(e[inverse], np.exp(self.trans), w.first)[0]


def switched(w: Words, lang: np.ndarray, rng) -> np.ndarray:
    """Indices of words in code-switched sequences of LENGTH, one after the other; lang is that of each row.

    Every row is cut into stretches of 1 to STRETCH words. Each language has as many of them as that with the most: all, then again from the first on.
    All are put in random order, in as many passes, cut anew each, as SEQUENCES sequences need; the last sequence is filled with the first words.
    """
    rows, parts, held = np.unique(w.row), [], 0
    while held < SEQUENCES * LENGTH:
        cuts = np.cumsum(rng.integers(1, STRETCH + 1, len(w)))
        start = np.union1d(cuts[: np.searchsorted(cuts, len(w))], w.first[rows])
        size, of = np.diff(np.append(start, len(w))), lang[w.row[start]]
        by = [np.flatnonzero(of == i) for i in np.unique(of)]
        most = max(map(len, by))
        pick = rng.permutation(np.concatenate([np.resize(rng.permutation(x), most) for x in by]))
        parts.append(_ranges(start[pick], size[pick]))
        held += len(parts[-1])
    seq = np.concatenate(parts)
    return np.resize(seq, -(-len(seq) // LENGTH) * LENGTH)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of each range, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def fit(texts: list[str], langs: list[str], seed: int = 11) -> Field:
    """Learns from every word of the texts: a step takes about SEQUENCES sequences, and all of them are taken equally often, in STEPS steps or more."""
    labels = sorted(set(langs))
    k = len(labels)
    w = lower_words(pa.array(texts, pa.string()))
    field = Field(labels, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)))
    if k < 2 or not len(w):
        return field
    _, index, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
    code, at = features(w, index)
    size = np.diff(np.append(at, len(code)))
    lang = np.array([labels.index(x) for x in langs])
    seq = switched(w, lang, np.random.default_rng(seed))
    parts = -(-len(seq) // (SEQUENCES * LENGTH))
    parts = [p.ravel() for p in np.array_split(seq.reshape(-1, LENGTH), parts)]
    g2, t2 = np.full((BUCKETS, k), 1e-8, np.float32), np.full((k, k), 1e-8)
    for step in range(-(-STEPS // len(parts)) * len(parts)):
        part = parts[step % len(parts)]
        met, x = np.unique(inverse[part], return_inverse=True)
        n, y = size[met], lang[w.row[part]]
        own = code[_ranges(at[met], n)]  # the features of the words met
        first, inner = np.arange(0, len(part) + 1, LENGTH), np.flatnonzero(np.arange(len(part)) % LENGTH != 0)
        e = np.add.reduceat(field.weights[own], np.cumsum(n) - n, axis=0).astype(float)
        e = np.exp(np.clip(e - e.max(1, keepdims=True), -30, 0))
        trans = np.exp(field.trans)
        delta, _ = forward_backward(e[x], trans, first)
        delta *= -1
        delta[np.arange(len(part)), y] += 1
        word, of = np.stack([np.bincount(x, delta[:, j], len(met)) for j in range(k)], 1), np.repeat(np.arange(len(met)), n)
        grad = np.stack([np.bincount(own, word[of, j], BUCKETS) for j in range(k)], 1) / len(part) - PENALTY * field.weights
        # expected transitions by the pairwise probabilities
        pair = _pairs(e[x], trans, first, inner)
        seen = np.zeros((k, k))
        np.add.at(seen, (y[inner - 1], y[inner]), 1)
        tgrad = (seen - pair) / len(part) - PENALTY * field.trans
        g2 += grad**2
        t2 += tgrad**2
        field.weights += (0.5 * grad / np.sqrt(g2)).astype(np.float32)
        field.trans += 0.3 * tgrad / np.sqrt(t2)
    return field


def _pairs(potential, trans, first, inner) -> np.ndarray:
    """The summed probabilities of consecutive labels; all sequences have LENGTH words."""
    k = potential.shape[1]
    q = potential.reshape(-1, LENGTH, k)
    a = np.empty_like(q)
    b = np.ones_like(q)
    for t in range(LENGTH):
        a[:, t] = q[:, t] if t == 0 else (a[:, t - 1] @ trans) * q[:, t]
        a[:, t] /= a[:, t].sum(1, keepdims=True)
    for t in range(LENGTH - 2, -1, -1):
        b[:, t] = (b[:, t + 1] * q[:, t + 1]) @ trans.T
        b[:, t] /= b[:, t].sum(1, keepdims=True)
    joint = a[:, :-1, :, None] * trans * (q[:, 1:] * b[:, 1:])[:, :, None, :]
    return (joint / joint.sum((2, 3), keepdims=True)).sum((0, 1))


def train(documents: DataFrame, *, text: str = "text", lang: str = "lang", doc: str = "doc_id", use=None, sample_docs: int = SAMPLE_DOCS) -> Field:
    """Fits on at most sample_docs documents of known language, as many of each, with the smallest hashes of their ids; use is a condition on doc_id.

    Whole texts are learned from, however long. Rows of null language, id or text are left out, so are texts without letters; ties go by id;
    rows that share an id and a text are learned from once. Without any rows nothing is learned.
    """
    rows = documents.select(column(doc).alias("doc_id"), column(lang).cast("string").alias("lang"), column(text).cast("string").alias("text")).where("lang is not null and doc_id is not null")
    rows = rows if use is None else rows.where(use)
    langs = [r["lang"] for r in rows.select("lang").distinct().limit(MOST_LANGS + 1).collect()]
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not langs:
        return Field([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)))
    each = max(1, sample_docs // len(langs))
    # those of a text with a letter; first the least of each part of a language, so that no task sorts a language of very many documents
    found = rows.where(F.col("text").rlike(r"\p{L}")).select("lang", "doc_id", F.xxhash64("doc_id").alias("h"), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(_APART)).alias("part"))
    for by in (("lang", "part"), ("lang",)):
        found = found.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))).where(F.col("k") <= each)
    first = found.select("lang", "doc_id").distinct()
    picked = documents.sparkSession.createDataFrame([tuple(r) for r in first.collect()], first.schema)
    sample = rows.join(F.broadcast(picked), ["lang", "doc_id"]).where("text is not null").select("doc_id", "lang", "text")
    t = sample.distinct().toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("text", "ascending")])
    return fit(t["text"].to_pylist(), t["lang"].to_pylist())


_SPAN = pa.struct([("lang", pa.string()), ("word", pa.int64()), ("n_words", pa.int64())])


def label(documents: DataFrame, field: Field, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """documents' columns keep, lang_pred, score, and spans: the stretches of words that are likeliest in one language.

    Words are runs of letters. lang_pred has the largest summed probability over the words (of equal ones the first by name), and score is
    its mean. A text that is null or has no letter gives `und`, 0 and no spans, and so does any text if nothing was learned; a very long text
    is labelled whole; repeated rows each give a row; no rows give none; columns not in keep are not read, and one of them that has a
    result's name gets _ at its end.
    """
    sent = documents.sparkSession.sparkContext.broadcast(field)
    docs, read = kept_columns(documents, keep, text)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, read, _SHARD):
                yield _labelled(part, read, sent.value, carried(keep))

    schema = docs.select(*carried(keep), F.expr("cast(null as string) as lang_pred"), F.expr("cast(null as double) as score"), F.expr("cast(null as array<struct<lang:string,word:bigint,n_words:bigint>>) as spans")).schema
    return restored(docs.mapInArrow(lean(run), schema), keep, "lang_pred", "score", "spans")


def _labelled(part: pa.RecordBatch, read: str, field: Field, kept: list[str]) -> pa.RecordBatch:
    rows = part.num_rows
    known = pc.match_substring_regex(part.column(read), r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False).copy()
    names, score = np.full(rows, "und", object), np.zeros(rows)
    spans = pa.array([[]] * rows, pa.list_(_SPAN))
    if field.labels and rows:
        w = lower_words(part.column(read))
        p = field.probabilities(w)
        n = w.counts()
        total = np.stack([np.bincount(w.row, p[:, j], rows) for j in range(len(field.labels))], 1)
        best = total.argmax(1)
        known &= n > 0
        names[known] = np.array(field.labels, object)[best[known]]
        score = np.where(known, np.minimum(total[np.arange(rows), best] / np.maximum(n, 1), 1), 0)
        if len(w):
            of = p.argmax(1)
            new = np.ones(len(w), bool)
            new[1:] = (of[1:] != of[:-1]) | (w.row[1:] != w.row[:-1])
            at = np.flatnonzero(new & known[w.row])
            size = np.diff(np.append(np.flatnonzero(new), len(w)))[known[w.row[np.flatnonzero(new)]]]
            values = pa.StructArray.from_arrays([pa.DictionaryArray.from_arrays(pa.array(of[at].astype(np.int32)), pa.array(field.labels, pa.string())).dictionary_decode(), pa.array(at - w.first[w.row[at]]), pa.array(size)], fields=list(_SPAN))
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(w.row[at], np.arange(rows + 1)), pa.int32()), values)
    return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(names, pa.string()), pa.array(score), spans], [*kept, "lang_pred", "score", "spans"])


def held_out(doc: str = "doc_id"):
    return fold(F.col(doc), 4) == 2
