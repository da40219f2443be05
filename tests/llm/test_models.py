"""The models against their definitions: Kneser-Ney by counting in dictionaries, the field's gradient by differences, log ratios and statistics one by one."""

import random
import re
from collections import Counter, defaultdict
from math import log, log1p, sqrt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gammaweave.llm import langid, qclass, qrules, tokencount, toxicity

from .common import documents, rows, sentence

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def brute_ratio(texts):
    """A function of a word: log P(word | 1) - log P(word | 0), from (class, words); interpolated Kneser-Ney over bytes, order 7."""
    order, d, dc = toxicity.ORDER, toxicity.DISCOUNT, toxicity.CLASS_DISCOUNT
    pad = lambda w: b" " * (order - 1) + w.encode() + b" "
    cut = lambda w: [pad(w)[k : k + order] for k in range(len(w.encode()) + 1)]
    by = [Counter(), Counter()]
    for c, words in texts:
        for w in words:
            by[c].update(cut(w))
    levels = [None] * (order + 1)
    levels[order] = by[0] + by[1]
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])  # how many different bytes come before
    total, kinds = [defaultdict(int) for _ in range(order + 1)], [defaultdict(int) for _ in range(order + 1)]
    for n in range(1, order + 1):
        for g, c in levels[n].items():
            total[n][g[:-1]] += c
            kinds[n][g[:-1]] += 1

    def shared(g):
        below = shared(g[1:]) if len(g) > 1 else 1 / 256
        n = len(g)
        if not total[n][g[:-1]]:
            return below
        return (max(levels[n][g] - d, 0) + d * kinds[n][g[:-1]] * below) / total[n][g[:-1]]

    class_total = [defaultdict(int), defaultdict(int)]
    freed = [defaultdict(float), defaultdict(float)]
    for c in (0, 1):
        for g, n in by[c].items():
            class_total[c][g[:-1]] += n
            freed[c][g[:-1]] += min(n, dc)

    def p(g, c):
        t = class_total[c][g[:-1]]
        return (max(by[c][g] - dc, 0) + freed[c][g[:-1]] * shared(g)) / t if t else shared(g)

    return lambda w: sum(log(p(g, 1)) - log(p(g, 0)) for g in cut(w))


def test_kneser_ney_by_dictionaries(spark):
    r = random.Random(51)
    make = lambda a: [r.choice(a) + r.choice(["ing", "ed", "", "er"]) for _ in range(40)]
    texts = [(k % 2, make(["walk", "talk", "wink"] if k % 2 else ["tell", "walk", "sell"])) for k in range(24)]
    ratio = brute_ratio(texts)
    d = spark.createDataFrame([(k, " ".join(w)) for k, (_, w) in enumerate(texts)], "doc_id long, text string").repartition(3)
    model = toxicity.train(d, spark.createDataFrame([(k, c) for k, (c, _) in enumerate(texts)], "doc_id long, toxic int"))
    words = ["walking", "sell", "talker", "winked", "tells", "quite", "w", "wal", "inging"]
    w = toxicity.lower_words(pa.array([" ".join(words)]))
    assert model.ratios.words(w, np.arange(len(w))).tolist() == pytest.approx([ratio(x) for x in words], abs=1e-4)
    # the first feature is the length-normalised comparison of the two log-likelihoods
    own = [texts[0][1], texts[1][1], words]
    got = toxicity.evidence(toxicity.lower_words(pa.array([" ".join(x) for x in own])), model.ratios)
    assert got[:, 0].tolist() == pytest.approx([sum(map(ratio, x)) / len(x) for x in own], abs=1e-4)


def test_gradient_of_the_field(monkeypatch):
    """One step of the fit goes along the gradient of the sequences' mean log-likelihood, found by differences."""
    monkeypatch.setattr(langid, "STEPS", 1)
    monkeypatch.setattr(langid, "SEQUENCES", 20)
    monkeypatch.setattr(langid, "PENALTY", 0.0)
    seen = {}
    real = langid._pairs
    monkeypatch.setattr(langid, "_pairs", lambda p, t, first, inner: seen.update(p=p, t=t, first=first) or real(p, t, first, inner))
    r = random.Random(4)
    texts = [" ".join(r.choice(["the", "and", "whe"] if k % 2 else ["der", "und", "sch"]) for _ in range(60)) for k in range(6)]
    langid.fit(texts, ["en" if k % 2 else "de" for k in range(6)])
    q, trans, first = np.random.default_rng(2).random(seen["p"].shape) + 0.2, np.array([[1.3, 0.6], [0.4, 1.1]]), seen["first"]

    def logs(q, trans):
        return np.log(langid.forward_backward(q, trans, first)[1]).sum()

    marginal, _ = langid.forward_backward(q, trans, first)
    pair, e = real(q, trans, first, None), 1e-6
    for i, j in ((0, 0), (0, 1), (1, 0)):
        moved = trans.copy()
        moved[i, j] *= np.exp(e)
        assert (logs(q, moved) - logs(q, trans)) / e == pytest.approx(pair[i, j], rel=1e-3)
    for n, j in ((0, 1), (5, 0), (47, 1), (50, 0)):
        moved = q.copy()
        moved[n, j] *= np.exp(e)
        assert (logs(moved, trans) - logs(q, trans)) / e == pytest.approx(marginal[n, j], abs=1e-4)


def test_features_of_words():
    w = toxicity.lower_words(pa.array(["Haus haus maus house"]))
    code, at = langid.features(w, np.arange(4))
    of = [set(code[a:b].tolist()) for a, b in zip(at, [*at[1:], len(code)], strict=True)]
    # marks at both ends: n-grams of 2, 3 and 4 places, and the word itself
    assert [len(code[a:b]) for a, b in zip(at, [*at[1:], len(code)], strict=True)] == [5 + 4 + 3 + 1] * 3 + [6 + 5 + 4 + 1]
    assert of[0] == of[1] and len(of[0] & of[2]) == 3 + 2 + 1 and len(of[0] & of[3]) == 2  # au, us, s and the end, aus, ...; the beginning and h, us


def test_log_ratios_and_verdicts(spark):
    r = random.Random(71)
    good = [(1000 + k, sentence(r, 60)) for k in range(80)]
    junk = [(2000 + k, " ".join("zz" + str(r.randrange(30)) for _ in range(60))) for k in range(12)]
    long_ = [(3000, sentence(r, 20_000)), (3001, "qq" + " qq" * 60)]
    docs = documents(spark, [(*x, *[None] * 11) for x in [*good, *junk, *long_]])
    lab = spark.createDataFrame([(i, 1) for i, _ in good[:70]] + [(i, 0) for i, _ in junk] + [(3000, 1), (None, 1)], "doc_id long, quality int")
    buckets = 256
    got = qrules.apply_rules(docs, lab, buckets=buckets, apart=20).collect()
    texts = [(x["doc_id"], BLANK.findall(x["text"] or "")) for x in docs.collect()]
    # buckets and halves by the engine's hash, the rest by hand
    words = sorted({w for _, ws in texts for w in ws})
    h = {x["w"]: x["h"] for x in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = sorted({p for _, ws in texts for p in zip(ws, ws[1:], strict=False)})
    h2 = {(x["a"], x["b"]): x["h"] for x in spark.createDataFrame([(a, b, h[a], h[b]) for a, b in pairs], "a string, b string, x long, y long").select("a", "b", F.xxhash64("x", "y").alias("h")).collect()}
    half = {x["doc_id"]: x["h"] for x in lab.where("quality = 1 and doc_id is not null").select("doc_id", F.xxhash64("doc_id", F.lit(3)).alias("h")).collect()}
    apart = {i for _, i in sorted((v, i) for i, v in half.items() if v % 2 == 0)[:20]}
    counted = set(half) - apart
    assert len(apart) == 20 and 3000 in counted | apart
    grams = lambda ws: [h[w] % buckets for w in ws] + [h2[p] % buckets for p in zip(ws, ws[1:], strict=False)]
    raw, own = Counter(), Counter()
    for i, ws in texts:
        raw.update(grams(ws))
        if i in counted:
            own.update(grams(ws))
    s = qrules.SMOOTH
    weight = {b: round((log((own[b] + s) / (sum(own.values()) + s * buckets)) - log((raw[b] + s) / (sum(raw.values()) + s * buckets))) * qrules.UNIT) for b in raw}

    def mean(ws):
        g = grams(ws)
        total = sum(weight[b] for b in g)
        return (abs(total) * 10**6 // (len(g) * qrules.UNIT)) * (1 if total >= 0 else -1) if g else 0

    tried = [mean(ws) for i, ws in texts if i in apart and len(ws) >= 20]
    m = sum(tried) / len(tried)
    least = int(m - qrules.DEVIATIONS * sqrt(sum(x * x for x in tried) / len(tried) - m * m))
    want = Counter((i, len(ws), mean(ws)) for i, ws in texts)
    assert Counter((x["doc_id"], x["n_words"], round(x["log_ratio"] * 1e6)) for x in got) == want
    verdict = {(x["doc_id"], x["n_words"]): x["kept"] for x in got if not x["base_failed"]}
    assert all(kept == (mean(ws) >= least) for i, ws in texts if (kept := verdict.get((i, len(ws)))) is not None)
    assert any(verdict.values()) and not all(verdict.values())


def brute_statistics(t):
    t = t or ""
    b = t.encode()
    kind = [qclass._class(x) for x in b]
    size = max(len(b), 1)
    w, lines = BLANK.findall(t), [x for x in t.split("\n") if x]
    n, m = max(len(w), 1), max(len(lines), 1)
    four = list(zip(w, w[1:], w[2:], w[3:], strict=False))
    ascii_caps = [x for x in w if len(x.encode()) > 1 and "A" <= x[0] <= "Z" and not re.search("[a-z]", x)]
    out = [kind.count(k) / size for k in range(8)]
    out += [log1p(len(w)), sum(len(x.encode()) for x in w) / n, len(set(w)) / n, sum(x == y for x, y in zip(w, w[1:], strict=False)) / n, sum(x == y for x, y in zip(w, w[2:], strict=False)) / n]
    out += [sum(qclass._class(x.encode()[-1]) == 4 for x in w) / n, len(ascii_caps) / n, log1p(len(lines)), log1p(sum(len(x.encode()) for x in lines) / m), len(set(lines)) / m, 1 - len(set(four)) / max(len(four), 1) if len(w) > 3 else 0]
    return out


def test_statistics_one_by_one():
    texts = [x[1] for x in rows()] + ["HELLO World ABC A!! a# ünï Z", "a a a b a b", "x\n\ny\nx\n", "one two three four one two three four five"]
    got = qclass.statistics(pa.array(texts, pa.string()))
    for t, x in zip(texts, got, strict=True):
        want = brute_statistics(t)
        if len(BLANK.findall(t or "")) <= 3:
            want[18] = x[18]  # of fewer than four words no window is whole
            assert x[18] in (0, 1)
        assert x.tolist() == pytest.approx(want), (t or "")[:60]


def test_the_first_split_is_the_best_one():
    r = np.random.default_rng(3)
    x, weight = np.round(r.random((200, 3)), 2), r.random(200) + 0.5
    y = (x[:, 1] + 0.1 * r.random(200) > 0.6).astype(float)
    m = qclass.fit(x, y, weight)
    p = np.average(y, weights=weight)
    g, h = weight * (p - y), np.full(200, p * (1 - p)) * weight
    score = lambda s: g[s].sum() ** 2 / (h[s].sum() + qclass.RIDGE)
    best = max((score(s) + score(~s), j) for j in range(3) for e in np.unique(np.quantile(x[:, j], np.linspace(0, 1, qclass.BINS)[1:-1])) if min((s := x[:, j] <= e).sum(), (~s).sum()) >= qclass.LEAST_LEAF)
    s = x[:, m.feature[0]] <= m.threshold[0]
    assert score(s) + score(~s) == pytest.approx(best[0]) and m.feature[0] == best[1]


def brute_count(model, word):
    best = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        options = [(best[a][0] + model.scores[word[a:e]], best[a][1] + 1) for a in range(max(0, e - model.longest), e) if word[a:e] in model.scores]
        if word[e - 1] not in model.scores:
            options.append((best[e - 1][0] + model.unknown, best[e - 1][1] + len(word[e - 1].encode())))
        top = max(o[0] for o in options)
        best.append(next(o for o in options if o[0] == top))
    return best[-1][1]


def test_long_words_without_blanks(monkeypatch):
    """Levels in arrays, chains, and the change from one to the other at any depth give the counts of plain dynamic programming."""
    import time

    r = random.Random(5)
    pieces = {c: -10.0 - k for k, c in enumerate("▁abcd")} | {"".join(r.choices("abcd", k=r.randrange(2, 9))): -round(r.random() * 15, 3) for _ in range(80)}
    model = tokencount.Unigram(list(pieces.items()))
    word = lambda n: "".join(r.choices("abcdéx🙂", k=n))
    stem = word(700)
    words = [word(n) for n in (1, 7, 255, 256, 257, 300, 900)] + [stem[:k] + word(r.randrange(1, 40)) for k in (0, 3, 200, 200, 500, 699)] + [stem, stem[:350]]
    words = sorted(set(words) | {word(r.randrange(1, 6)) for _ in range(60)}, key=lambda _: r.random())
    want = [brute_count(model, w) for w in words]
    for wide in (0, 1, 2, 5, 8, 20, 10**9):
        monkeypatch.setattr(tokencount, "WIDE", wide)
        assert model.counts(words).tolist() == want, wide
    monkeypatch.undo()
    assert model.counts(words).tolist() == want and model.counts([]).tolist() == [] and model.counts([""]).tolist() == [0]
    began = time.perf_counter()
    assert tokencount.Counter(list(pieces.items())).count(["ab" * 500_000])[1][0] > 0
    assert time.perf_counter() - began < 20


def test_every_trusted_document_counts_and_makes_the_threshold(spark):
    """No bound on those that the threshold comes from: each is judged by the half that it isn't in."""
    from pyspark.sql import functions as F

    docs = spark.range(60).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 29), k -> concat('w', (id * 7 + k * k) % 41))) AS text")
    good = docs.where("doc_id < 40").select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int").alias("half"))
    whole = {r["b"]: r for r in qrules.log_ratios(docs, good, buckets=64).collect()}
    for k in (0, 1):
        other = {r["b"]: r["w"] for r in qrules.log_ratios(docs, good.where(f"half <> {k}").select("doc_id"), buckets=64).collect()}
        assert other == {b: r[f"w{k}"] for b, r in whole.items()}
    assert {b: r["w"] for b, r in whole.items()} == {r["b"]: r["w"] for r in qrules.log_ratios(docs, good.select("doc_id"), buckets=64).collect()}
    seen = []
    kept, qrules.threshold = qrules.threshold, lambda spark, means, d: seen.append(means.count()) or kept(spark, means, d)
    try:
        assert qrules.apply_rules(docs, good.selectExpr("doc_id", "1 AS quality"), buckets=64).count() == 60
    finally:
        qrules.threshold = kept
    assert seen == [40]
