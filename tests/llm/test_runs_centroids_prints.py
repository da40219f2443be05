"""Periodic runs, centroid clustering and fingerprints against plain versions of their definitions."""

import hashlib
import random
import re
import zlib
from fractions import Fraction
from math import exp, floor

import numpy as np
import pyarrow as pa
import pytest

from gammaweave.llm import centroids, imatch, periodic, queries
from gammaweave.llm.text import ALNUM, words
from tests.conftest import DATA
from tests.llm.common import documents, empty, rows

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


# periodic runs


def plain_runs(w, least=6, exponent=4):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n, part = j - i + q, w[i : j + q]
            if n >= max(least, exponent * q) and not any(part[d:] == part[: n - d] for d in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def with_tail(doc, w):
    h = zlib.crc32(str(doc).encode())
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p if i >= a else i] for i in range(n)]


@pytest.mark.parametrize("kinds", [1, 2, 3, 6])
def test_all_repeats_are_found(kinds):
    r = random.Random(kinds)
    for _ in range(250):
        w = [r.randrange(kinds) for _ in range(r.randrange(1, 50))]
        if r.random() < 0.5:
            w = w[: r.randrange(1, 10)] + [r.randrange(kinds) for _ in range(r.randrange(1, 12))] * r.randrange(2, 6) + w
        first, length, period = periodic.repeats(np.array([100, *w, 101]))
        assert sorted(zip((first - 1).tolist(), length.tolist(), period.tolist(), strict=True)) == sorted(plain_runs(w, 2, 2))


def test_runs_within_rows_only():
    r = random.Random(5)
    for _ in range(150):
        texts = [[r.randrange(k) for _ in range(r.randrange(0, 30))] * r.randrange(1, 6) for k in (1, 2, 5, 40)]
        row = np.repeat(np.arange(4), [len(t) for t in texts])
        base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        first, length, period = periodic.runs_of(row, np.array(sum(texts, []), np.uint64))
        got = [[] for _ in texts]
        for a, n, q in zip(first.tolist(), length.tolist(), period.tolist(), strict=True):
            got[row[a]].append((a - int(base[row[a]]), n, q))
        assert got == [plain_runs(t) for t in texts]


def test_long_texts_of_one_word_and_of_long_periods():
    n = 60_000
    for w, want in ((np.zeros(n, int), (1, n, 1)), (np.tile(np.arange(900), n // 900), (1, n // 900 * 900, 900))):
        first, length, period = periodic.repeats(np.concatenate([[1 << 40], w, [1 << 41]]))
        assert (want[0], want[1], want[2]) in set(zip(first.tolist(), length.tolist(), period.tolist(), strict=True))


EXTRA = [(500, "a b " * 9 + "c", "en", None, 1, 1, "a", 2, 3, "k", "r", 0.5, "t"), (501, " ".join(f"w{i}" for i in range(40)) + " x" * 6 + "\n" + "p q r " * 4, None, None, 1, 1, "a", 2, 3, "k", "r", 0.5, "t")]


def test_runs_of_documents(spark):
    docs = documents(spark, EXTRA)
    want = []
    for r in [*rows(), *EXTRA]:
        w = BLANK.findall(r[1] or "")
        found = plain_runs(w)
        want.append((r[0], found, plain_collapsed(w, found)))
    got = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(found for _, found, _ in want)
    assert periodic.periodic_runs(empty(spark)).count() == 0


def test_periodic_tails(spark):
    more = [(10_000 + k, " \t".join(f"w{i}" for i in range(k + 1)), None, None, 1, 1, "a", 2, 3, "k", "r", 0.5, "t") for k in range(60)]
    got = {r["doc_id"]: r["text"] for r in periodic.with_periodic_tails(documents(spark, more)).where("doc_id >= 10000").collect()}
    for r in more:
        assert BLANK.findall(got[r[0]]) == with_tail(r[0], BLANK.findall(r[1]))
    assert sum(got[r[0]] != r[1] for r in more) > 2
    assert periodic.with_periodic_tails(empty(spark)).count() == 0


def test_query_of_runs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in docs:
        w = with_tail(r["doc_id"], BLANK.findall(r["text"] or ""))
        if len(w) > 1500:
            continue  # the plain version is quadratic
        found = plain_runs(w)
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        want[r["doc_id"]] = (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(plain_collapsed(w, found)))
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = {r["doc_id"]: tuple(r[x] for x in names) for r in queries.op11_periodic_runs(spark, str(DATA)).collect()}
    assert {k: got[k] for k in want} == want
    assert sum(x[0] > 0 for x in want.values()) > 5 and len(got) == len(docs)


# centroid clustering


def plain_clusters(vectors, k, rounds, size=64):
    kept = [(i, [floor(64 * float(np.float32(c))) for c in v]) for i, v in vectors if v is not None and len(v) == size and all(c is not None and np.isfinite(c) for c in v)]
    c = [v for _, v in sorted(((sha(f"1:{'null' if i is None else i}"), v) for i, v in kept))][:k]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), n) for n, x in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        groups = [[v for (_, v), o in zip(kept, of, strict=True) if o == n] for n in range(len(c))]
        c = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else old for g, old in zip(groups, c, strict=True)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = [sum(d for _, n, d in out if n == k) for k in range(len(c))]
    return sorted(((i, n, d, inertia[n], sum(inertia), c[n]) for i, n, d in out), key=str)


def test_annulus_search_is_exact():
    r = np.random.default_rng(4)
    for size, k, most in ((2, 40, 4), (3, 7, 30), (64, 16, 200), (5, 1, 3), (4, 30, 1 << 26)):
        x, c = r.integers(-most, most + 1, (300, size)), r.integers(-most, most + 1, (k, size))
        c[k // 2] = c[0]
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        cluster, distance = centroids.nearest(x, c)
        assert (cluster == d.argmin(1)).all() and (distance == d.min(1)).all()


def test_clusters(spark):
    r = random.Random(2)
    vectors = [(k, [r.gauss(0, 1) for _ in range(64)]) for k in range(60)]
    vectors += [(60, None), (61, []), (62, [1.0] * 63), (63, [1.0] * 65), (64, [1.0] * 63 + [None]), (65, [float("nan")] + [0.0] * 63), (66, [float("inf")] * 64)]
    vectors += [(70 + k, vectors[3][1]) for k in range(20)] + [vectors[5], vectors[5], (None, vectors[7][1]), (90, [0.0] * 64), (91, [-0.001] * 64)]
    table = spark.createDataFrame([(v, i, 1, [2], 3) for i, v in vectors], "embedding array<float>, vec_id long, cluster int, centroid array<int>, v int").repartition(3)
    got = sorted((tuple(x) for x in centroids.cluster(table, 16, 3).collect()), key=str)
    assert got == plain_clusters(vectors, 16, 3)
    few = table.where("vec_id in (1, 2, 61)")
    assert sorted((tuple(x) for x in centroids.cluster(few, 16, 3).collect()), key=str) == plain_clusters(vectors[1:3], 16, 3)
    assert centroids.cluster(table.where("vec_id = 61"), 16, 3).count() == 0
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).count()


# fingerprints


def hash_of(word):
    return int(words(pa.array([word]), ALNUM).hashes()[0])


def plain_prints(texts, n, df):
    low, high = n * exp(-imatch.MAX_IDF), max(2.0, n * exp(-imatch.MIN_IDF))
    out = []
    for t in texts:
        every = {w for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))}
        terms = {w for w in every if low <= df.get(w, 0) <= high and w in df}
        terms = sorted(hash_of(w) >> 20 for w in (terms if len(terms) >= imatch.FEW else every))
        if not terms:
            out.append((t,))
            continue
        level = max(0, (len(set(terms)) // 32).bit_length() - 1)
        subset = lambda s, k: tuple(x for x in sorted(set(terms)) if x >> 38 == s and x & (1 << 38) - 1 < 1 << 38 - level - k)  # noqa: B023, E731
        out.append((level, [[subset(s, k) for s in range(64)] for k in (0, 1)]))
    return out


def plain_likeness(a, b):
    if len(a) == 1 or len(b) == 1 or abs(a[0] - b[0]) > 1:
        return float(a == b)
    deep = max(a[0], b[0])
    pairs = [(x, y) for x, y in zip(a[1][deep - a[0]], b[1][deep - b[0]], strict=True) if x or y]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else float(a[0] == b[0])


@pytest.mark.parametrize("size", [4 << 20, 700])
def test_fingerprints(spark, monkeypatch, size):
    monkeypatch.setattr(imatch, "RANGE", size)  # many ranges, or one
    docs = [(r[0], r[1] or "") for r in [*rows(), *EXTRA]]
    r = random.Random(8)
    long = [(1000 + k, " ".join(f"v{r.randrange(3000)}" for _ in range(r.randrange(1, 900)))) for k in range(60)]
    more = [(i, t, None, None, 1, 1, "a", 2, 3, "k", "r", 0.5, "t") for i, t in long]
    docs = sorted([*docs, *long], key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    df: dict = {}
    for _, t in docs:
        for w in {w for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))}:
            df[w] = df.get(w, 0) + 1
    after = [t for _, t in docs[1:]] + [docs[0][1]]
    edited = [t[: len(t) - len(t) // 4] + b[: len(t) // 4] for (_, t), b in zip(docs, after, strict=True)]
    own, other = plain_prints([t for _, t in docs], len(docs), df), plain_prints(edited, len(docs), df)
    want = sorted(((d[0], len(d[1]), sha(e), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)) for d, e, a, b, c in zip(docs, edited, own, other, own[1:] + own[:1], strict=True)), key=str)
    # null and empty texts are told apart by the table only, so of null ids the order among empty ones doesn't matter
    done = imatch.edited_and_next(documents(spark, [*EXTRA, *more])).collect()
    got = sorted(((x["doc_id"], x["n_chars"], x["edited_sha256"], round(x["near_edited"], 9), round(x["near_next"], 9)) for x in done), key=str)
    assert got == want
    text_of, of = dict(docs), {}
    for x in imatch.fingerprints(documents(spark, [*EXTRA, *more])).where("doc_id is not null").collect():
        of.setdefault(text_of[x["doc_id"]], set()).add(x["fingerprint"])
    assert all(len(v) == 1 for v in of.values()) and len(set().union(*of.values())) > len(of) - 3
    assert set().union(*of.values()) == {x["fingerprint"] for x in done if x["doc_id"] is not None}
    a = imatch.Prints.of([x["fingerprint"] for x in done])
    b = imatch.Prints.of([x["edited_fingerprint"] for x in done])
    at = np.arange(len(done))
    assert imatch.likeness(a, at, b, at).tolist() == [x["near_edited"] for x in done]


def test_fingerprints_of_few_documents(spark):
    assert imatch.edited_and_next(empty(spark)).count() == 0 and imatch.fingerprints(empty(spark)).count() == 0
    one = imatch.edited_and_next(spark.createDataFrame([("x", "a b c d")], "doc_id string, text string")).collect()
    assert [(r["doc_id"], r["n_chars"], r["near_next"]) for r in one] == [("x", 7, 1.0)]
    with pytest.raises(ValueError, match="max_idf"):
        counted = spark.range(3).selectExpr("IF(id = 0, null, id) AS h", "1L AS n", "1L AS size")
        limit, imatch.MOST_TERMS = imatch.MOST_TERMS, 1
        try:
            imatch.lexicon(counted)
        finally:
            imatch.MOST_TERMS = limit


def test_edited_texts_are_nearer_than_neighbours(spark):
    got = queries.op13_document_fingerprints(spark, str(DATA)).toPandas()
    assert (got.near_edited > got.near_next).mean() > 0.95 and got.near_edited.mean() > 0.4 and got.near_next.mean() < 0.05
