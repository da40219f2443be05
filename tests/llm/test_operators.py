import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gammaweave.llm import bpe, decontaminate, jaccard, langid, licenses, linededup, qclass, qrules, tokencount, toxicity
from gammaweave.llm.text import ALNUM, NONBLANK, words

from .common import documents, empty, rows, sentence

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s or "")


def test_words_and_hashes():
    texts = [None, "", "Ab c", "ÄB\tc  d ", "c", "Ab"]
    for table, pattern in ((ALNUM, WORD), (NONBLANK, BLANK)):
        w = words(pa.array(texts, pa.string()), table)
        want = [pattern.findall(low(t)) for t in texts]
        assert [[w.text(i).decode() for i in range(w.first[r], w.first[r + 1])] for r in range(len(texts))] == want
        seen = {}
        for i, h in enumerate(w.hashes().tolist()):
            assert seen.setdefault(w.text(i), h) == h
        assert len({*seen.values()}) == len(seen)


def test_decontamination(spark):
    r = random.Random(3)
    base = [x[1] for x in rows() if x[1] and len(x[1]) > 200]
    items = [(1, " ".join(base[0].split()[5:40])), (10, " ".join(base[4].split()[:10]).upper()), (2, "one two"), (3, sentence(r, 30)), (4, None), (5, ""), (None, " ".join(base[0].split()[20:31])), (1, " ".join(base[0].split()[5:40]))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    docs = documents(spark)
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall(low(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add("null" if i is None else str(i))

    def brute(t):
        w, hit, ids = WORD.findall(low(t)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    ids |= found
        return len(w), len(hit), tuple(sorted(ids))

    want = sorted(((x[0], *brute(x[1])) for x in rows()), key=str)
    for block in (decontaminate.BLOCK_WORDS, 20):
        got = decontaminate.contamination(docs, bench, block_words=block)
        assert sorted(((x["doc_id"], x["n_words"], x["n_hit"], tuple(x["item_ids"])) for x in got.collect()), key=str) == want
        assert all(sum(s["n_words"] for s in x["spans"]) == x["n_hit"] for x in got.collect())
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(1 for x in want if not x[2])
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").isEmpty()


def test_longest_matches(spark):
    r = random.Random(31)
    texts = {k: " ".join(r.choice("abcde") for _ in range(r.randrange(0, 60))) for k in range(30)} | {30: None, 31: ""}
    items = [("x", " ".join(texts[3].split() + texts[4].split())), ("y", "a b c zz a b"), ("z", "zz"), ("n", None), ("e", "")]
    d = spark.createDataFrame([*texts.items(), (3, texts[3])], "doc_id long, text string").repartition(3)
    got = {(x["item_id"], x["item_word"]): (x["n_words"], x["doc_id"], x["doc_word"], x["n_places"]) for x in decontaminate.longest_matches(d, spark.createDataFrame(items, "item_id string, text string")).collect()}
    want, split = {}, [(k, (x or "").split()) for k, x in [*texts.items(), (3, texts[3])]]
    for name, t in items:
        w = (t or "").split()
        for a in range(len(w)):
            for n in range(len(w) - a, 0, -1):
                places = [(k, b) for k, v in split for b in range(len(v) - n + 1) if v[b : b + n] == w[a : a + n]]
                if places:
                    want[name, a] = (n, *min(places), len(places))
                    break
    assert got == want


def test_long_items_take_time_in_proportion():
    import time

    r = np.random.default_rng(8)
    long_ = [f"w{x}" for x in r.integers(0, 3000, 64_000)]
    took = []
    for n in (8000, 64_000):
        text = " ".join(long_[:n])
        items = decontaminate.index_items(["a"], [text])
        part = pa.record_batch([pa.array(["x y", text])], ["text"])
        began = time.perf_counter()
        n_words, n_hit, ids, _ = decontaminate.match_shard(part, "text", [items], 10)
        w = words(part.column("text"), ALNUM)
        length, _, many = decontaminate.longest(decontaminate._ids(w, w.hashes(), 2, items), items)
        took.append(time.perf_counter() - began)
        assert n_hit.tolist() == [0, n] and ids == [(1, "a")] and (length == np.arange(n, 0, -1)).all() and (many >= 1).all()
    assert took[1] < 8 * 2.5 * max(took[0], 0.05)


def test_suffix_array_of_large_numbers():
    r = np.random.default_rng(6)
    for top in (1 << 22, 1 << 40):
        ids = np.append(r.choice(r.integers(1, top, 20), 2000), 0)
        sa = decontaminate.suffix_array(ids, 50)
        keys = [tuple(ids[x : x + 50].tolist()) for x in sa.tolist()]
        assert keys == sorted(keys)


def test_suffix_array_against_sorting():
    r = np.random.default_rng(5)
    ids = np.append(r.integers(0, 4, 3000), 0)
    sa = decontaminate.suffix_array(ids, 200)
    key = lambda p: tuple(ids[p : p + np.argmin(ids[p:])].tolist())
    assert sorted(sa.tolist()) == np.flatnonzero(ids).tolist()
    keys = [key(p) for p in sa.tolist()]
    assert all(a[:200] <= b[:200] or a[: len(b)] == b or b[: len(a)] == a for a, b in zip(keys, keys[1:], strict=False))


def test_toxicity(spark):
    r = random.Random(4)
    docs = [(k, sentence(r, 60) + (f" vile{r.choice(['en', 'er', 'ing'])}" * 2 + " " + sentence(r, 30) if k % 4 == 0 else " " + sentence(r, 32))) for k in range(400)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(300)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(d, lab, use=~toxicity.held_out())
    got = {x["doc_id"]: x["score"] for x in toxicity.score(d, model).collect()}
    assert all((got[k] >= 0.5) == (k % 4 == 0) for k in got)
    again = {x["doc_id"]: x["score"] for x in toxicity.score(d, toxicity.train(d, lab, use=~toxicity.held_out())).collect()}
    assert again == got
    odd = toxicity.score(documents(spark), model).collect()
    assert len(odd) == len(rows()) and all(0 <= x["score"] <= 1 for x in odd)
    assert toxicity.score(empty(spark), model).count() == 0
    none = toxicity.train(d, lab.where("toxic = 0"))
    assert toxicity.score(d, none).where("score >= 0.5").isEmpty()


def test_toxicity_counts_all_labelled_documents(spark, monkeypatch):
    r = random.Random(41)
    docs = [(k, sentence(r, 40) + (" vileness" if k % 2 else "")) for k in range(80)] + [(80, sentence(r, 9000) + " qwzzk" * 9), (81, "qwzzk " * 9 + sentence(r, 30))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(80, 1), (81, 1)], "doc_id long, toxic int")
    w = toxicity.lower_words(pa.array([t for _, t in docs]))
    toxic = np.array([k % 2 if k < 80 else 1 for k, _ in docs])[w.row]
    code, n = toxicity.grams(w, np.arange(len(w)))
    got, inverse = np.unique(code, return_inverse=True)
    want = toxicity.fit_ratios(got, np.stack([np.bincount(inverse, np.repeat(toxic == c, n), len(got)) for c in (0, 1)]))
    words = toxicity.lower_words(pa.array(["qwzzk vileness mat cat unheard qwzzx"]))
    for size in (toxicity.BLOCK, 16):  # as one block, and as many
        monkeypatch.setattr(toxicity, "BLOCK", size)
        # a sample of 5 and 5 for the logistic fit; the counts are of all, the long text as well
        model = toxicity.train(d, lab, toxic_docs=5, other_docs=5)
        assert (len(model.ratios.sent) > 4) == (size == 16)
        for some in (w, words):
            assert model.ratios.words(some, np.arange(len(some))) == pytest.approx(want.words(some, np.arange(len(some))), abs=1e-4)
        assert toxicity.score(d, model).count() == len(docs)
    assert want.words(words, np.arange(1))[0] > 2


def test_evidence_has_the_right_sign():
    w = toxicity.lower_words(pa.array(["ab abc abd bcd", "zz ab"]))
    code, n = toxicity.grams(w, np.arange(len(w)))
    got, inverse = np.unique(code, return_inverse=True)
    counts = np.stack([np.bincount(inverse, k, len(got)) for k in (np.repeat(w.row == 0, n), np.repeat(w.row == 1, n))])
    ratios = toxicity.fit_ratios(got, 10 * counts)
    assert np.isfinite(ratios.of_gram).all() and np.isfinite(ratios.of_context).all()
    own = ratios.words(w, np.arange(len(w)))
    assert own[4] > 0 > own[3]  # zz is of the second class, bcd of the first


def test_language_id(spark):
    r = random.Random(6)
    word = {"en": lambda: r.choice(["th", "wh", "sh"]) + r.choice(["ing", "ed", "er"]) + r.choice("aeiou"), "de": lambda: r.choice(["sch", "zu", "ei"]) + r.choice(["ung", "heit", "lich"]) + r.choice("aeiou")}
    text = lambda lang, n: " ".join(word[lang]() for _ in range(n))
    docs = [(k, text("en" if k % 2 else "de", 40), "en" if k % 2 else "de") for k in range(200)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    field = langid.train(d, use=~langid.held_out())
    assert langid.label(d, field).join(d, "doc_id").where("lang != lang_pred").isEmpty()
    mixed = spark.createDataFrame([(1, text("en", 20) + " " + text("de", 30) + " " + text("en", 10))], "doc_id long, text string")
    spans = langid.label(mixed, field).first()["spans"]
    assert [(s["lang"], s["word"], s["n_words"]) for s in spans] == [("en", 0, 20), ("de", 20, 30), ("en", 50, 10)]
    odd = langid.label(documents(spark), field).collect()
    assert len(odd) == len(rows())
    texts = defaultdict(set)
    for x in rows():
        texts[x[0]].add(any(c.isalpha() for c in x[1] or ""))
    assert all((x["lang_pred"] == "und") == (False in texts[x["doc_id"]]) or len(texts[x["doc_id"]]) > 1 for x in odd)
    assert langid.label(empty(spark), field).count() == 0
    assert langid.label(d, langid.train(d.limit(0))).where("lang_pred != 'und'").isEmpty()


def test_a_language_of_long_texts_is_learned(spark):
    docs = [(k, " ".join(f"sch{k % 7}ung zu{j % 11}heit" for j in range(4000)), "aa") for k in range(12)] + [(100 + k, " ".join(f"whi{k % 5}ng the{j % 9}" for j in range(30)), "bb") for k in range(12)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    field = langid.train(d)
    assert field.labels == ["aa", "bb"] and langid.label(d, field).join(d, "doc_id").where("lang != lang_pred").isEmpty()


def test_every_word_of_a_text_is_learned_from(monkeypatch):
    """A very long text among short ones: each pass has every word of it, and of the other languages as many stretches; the sequences are whole."""
    monkeypatch.setattr(langid, "SEQUENCES", 50)
    texts = [" ".join(f"a{chr(97 + j % 26)}" for j in range(9000)), "bb " * 70, "", "ccc", "bbb"]
    w = toxicity.lower_words(pa.array(texts))
    lang = np.array([0, 1, 1, 2, 1])
    seq = langid.switched(w, lang, np.random.default_rng(3))
    assert set(seq.tolist()) == set(range(len(w))) and len(seq) % langid.LENGTH == 0
    n = np.bincount(lang[w.row[seq]])
    assert (np.bincount(seq, minlength=len(w))[:9000] <= 2).all() and n[0] < 9000 + langid.LENGTH and n[1] > 0.6 * n[0] and n[2] > n[0] / langid.STRETCH
    few = langid.switched(toxicity.lower_words(pa.array(["one", "zwei"])), np.array([0, 1]), np.random.default_rng(3))
    assert set(few.tolist()) == {0, 1} and len(few) == 50 * langid.LENGTH
    again = langid.switched(w, lang, np.random.default_rng(3))
    assert (seq == again).all()


def test_forward_backward_against_all_paths():
    r = np.random.default_rng(1)
    p, t = r.random((7, 3)) + 0.1, r.random((3, 3)) + 0.1
    first = np.array([0, 4, 4, 7])
    got, _ = langid.forward_backward(p, t, first)
    for a, b in ((0, 4), (4, 7)):
        n = b - a
        total = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            v = np.prod([p[a + k, x] for k, x in enumerate(path)]) * np.prod([t[x, y] for x, y in zip(path, path[1:], strict=False)])
            for k, x in enumerate(path):
                total[k, x] += v
        assert got[a:b] == pytest.approx(total / total.sum(1, keepdims=True))


def brute_lines(docs, least):
    texts = sorted({(d is not None, d, t) for d, t in docs if t is not None}, key=lambda x: (x[0], x[1] or 0, x[2]))
    place, out = {}, defaultdict(set)
    stretches = []
    for k, (_, d, t) in enumerate(texts):
        lines = t.split("\n")
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x) + 1 for x in lines[a:b]) >= least:
                    stretches.append((k, a, tuple(lines[a:b]), (d, t)))
    for k, a, body, _ in stretches:
        place[body] = min(place.get(body, (k, a)), (k, a))
    for k, a, body, key in stretches:
        if place[body] != (k, a):
            out[key].update(range(a, a + len(body)))
    return out


def test_line_dedup(spark):
    r = random.Random(8)
    lines = ["line " + sentence(r, 3) for _ in range(12)] + ["", "x", "A longer line, which alone has all the characters that are needed"]
    docs = [(k, "\n".join(r.choice(lines) for _ in range(r.randrange(1, 12)))) for k in range(40)]
    docs += [docs[3], docs[3], (None, docs[5][1]), (7001, None), (7002, ""), (7003, "\n\n\n"), (7004, "same\n" * 40)]
    d = spark.createDataFrame([(*x, 1, "t") for x in docs], "doc_id long, text string, pos int, removed string").repartition(3)
    # one text a doc_id here, so the order by the hash of the text doesn't matter
    want = brute_lines(docs, linededup.MIN_CHARS)
    got = linededup.line_report(d).join(d.select("doc_id", "text").distinct(), "doc_id").collect()
    assert {(x["doc_id"], tuple(x["removed"])) for x in got} == {(i, tuple(sorted(want[i, t]))) for i, t in docs if i is not None}
    rows_of = {(x["doc_id"], x["text"]): x for x in got}
    for (i, t), x in rows_of.items():
        own = (t or "").split("\n")
        covered = set()
        for a, n, first, b in x["runs"]:
            source = next(u for j, u in docs if j == first).split("\n")
            assert own[a : a + n] == source[b : b + n] and (first is None or first < i or first == i and b < a)
            covered |= set(range(a, a + n))
        assert covered == want[i, t]
    texts = Counter((x["doc_id"], x["text"]) for x in linededup.dedup_lines(d).collect())
    cut = lambda i, t: t if t is None or not want[i, t] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i, t])
    assert texts == Counter((i, cut(i, t)) for i, t in docs)
    assert linededup.dedup_lines(d).columns == d.columns
    assert linededup.line_report(empty(spark)).count() == 0 and linededup.dedup_lines(empty(spark)).count() == 0
    assert linededup.dedup_lines(documents(spark)).count() == len(rows())


def test_a_copied_passage_is_one_run(spark):
    lines = [f"line {k} of a passage that is copied whole" for k in range(300)]
    docs = [(1, "\n".join(["alone here", *lines])), (2, "\n".join([*lines[100:], "a line of its own", *lines[:50]])), (3, "short\nline 7 of a passage that is copied whole"), (4, "short")]
    got = {x["doc_id"]: [tuple(y) for y in x["runs"]] for x in linededup.line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(0, 200, 1, 101), (201, 50, 1, 1)], 3: [(1, 1, 1, 8)], 4: []}


def test_short_repeated_lines_go(spark):
    docs = [(k, f"text number {k} alone\nAnd there is the end of it.\nTo.\nmore of {k} " + "x" * k) for k in range(6)]
    got = {x["doc_id"]: list(x["removed"]) for x in linededup.line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {k: [1, 2] if k else [] for k in range(6)}  # a line of 27 characters, and with it the shorter one that always follows it


def test_bpe(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    docs = documents(spark, [(900 + k, t, *[None] * 11) for k, t in enumerate(["'s'll don't", "aaaa aaaa a", "日本語 テキスト", "\r\n\r\n  x", "🙂🙂 á"])])
    ranks = bpe.Vocabulary(open(path, "rb").read()).ranks
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((x["doc_id"], tuple(t.encode_ordinary(x["text"] or "")), (x["text"] or "").encode()) for x in docs.collect())
    done = bpe.encode(docs, path, P.PATTERN, decode=True)
    assert Counter((x["doc_id"], tuple(np.frombuffer(x["ids"], "<u4").tolist()), bytes(x["decoded"])) for x in done.collect()) == want
    assert bpe.decode(done.drop("decoded"), path).where("decoded is null").isEmpty()
    assert bpe.encode(empty(spark), path, P.PATTERN).count() == 0


def test_merges_that_bring_up_earlier_ranks():
    import base64

    import tiktoken

    r = random.Random(9)
    for _ in range(30):
        made = sorted({bytes(r.choices(b"ab", k=r.randrange(2, 6))) for _ in range(12)}, key=lambda _: r.random())
        tokens = [bytes([b]) for b in range(256)] + made
        data = b"\n".join(base64.b64encode(x) + f" {k}".encode() for k, x in enumerate(tokens))
        t = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks={x: k for k, x in enumerate(tokens)}, special_tokens={})
        texts = ["".join(r.choices("ab", k=r.randrange(1, 14))) for _ in range(60)]
        assert [x.tolist() for x in bpe.Encoder(data, r"\S+|\s+").encode(texts)] == t.encode_ordinary_batch(texts)


def brute_jaccard(docs, n, percent):
    sets = {}
    for i, t in docs:
        w = BLANK.findall(low(t))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard(spark):
    r = random.Random(10)
    docs, k = [], 0
    common = sentence(r, 40)
    for _ in range(12):
        base = sentence(r, r.randrange(3, 120)).split()
        for _ in range(r.randrange(1, 14)):
            w = list(base)
            for _ in range(r.randrange(0, 5)):
                w[r.randrange(len(w))] = sentence(r, 1)
            docs.append((k, " ".join(w) + (" " + common if k % 3 == 0 else "")))
            k += 1
    docs += [(k + j, t) for j, t in enumerate([None, "", "a b", "A  b", "a b c d", " \n ", "a b", "z " * 3000])]
    want = brute_jaccard(docs, 4, 85)
    d = spark.createDataFrame([(*x, 1, "t", 0) for x in docs], "doc_id long, text string, n int, token string, a long").repartition(4)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.linked(d).collect()}
    assert got == want
    want = brute_jaccard(docs, 2, 60)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.linked(d, ngram=2, percent=60).collect()} == want
    odd = jaccard.linked(documents(spark)).collect()
    assert len(odd) == len(rows()) and {x["component_id"] for x in odd if x["doc_id"] is None and x["n_shingles"]} == {None}
    assert jaccard.linked(empty(spark)).count() == 0


def test_jaccard_with_many_frequent_grams(spark, monkeypatch):
    r = random.Random(11)
    base = sentence(r, 80).split()
    docs = []
    for k in range(90):
        w = list(base)
        for _ in range(k % 6):
            w[r.randrange(len(w))] = sentence(r, 1)
        docs.append((k, " ".join(w)))
    for least in (2, 10**9):  # what is frequent changes nothing
        monkeypatch.setattr(jaccard, "FREQUENT", least)
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.linked(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
        assert got == brute_jaccard(docs, 4, 85)


def test_jaccard_with_salted_groups(spark, monkeypatch):
    """N-grams that are frequent, in groups that don't link as a whole, dealt by few salts and met in several rounds of pivots."""
    r = random.Random(19)
    common, docs = sentence(r, 30).split(), []
    for k in range(120):
        base = random.Random(k // 6)
        w = common + [base.choice("abcdefgh") + str(base.randrange(50)) for _ in range(60)]
        for _ in range(k % 4):
            w[30 + r.randrange(60)] = "new" + str(r.randrange(99))
        docs.append((k, " ".join(w)))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(jaccard, "SALTS", 3)
    for least in (2, 10**9):
        monkeypatch.setattr(jaccard, "FREQUENT", least)
        monkeypatch.setattr(jaccard, "LOCAL", 1)
        for n, percent in ((4, 85), (1, 60), (2, 70)):
            got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.linked(d, ngram=n, percent=percent).collect()}
            assert got == brute_jaccard(docs, n, percent)


def test_sketches_never_exclude_a_link():
    r = np.random.default_rng(7)
    for n in (3, 60, 170, 400, 5000):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(0.93 * len(a))], r.integers(0, 2**63, max(1, n // 20)).astype(np.uint64)]))
        differ = len(np.setxor1d(a, b))
        for kind in jaccard.sketches(np.concatenate([a, b]), np.array([len(a), len(b)])):
            x, y = (np.array(v, np.int64) for v in kind.to_pylist())
            if len(x) == len(y):
                assert sum(bin(int(v) & (2**64 - 1)).count("1") for v in x ^ y) <= differ


def test_jaccard_detail_tells_rows_of_one_id_apart(spark):
    docs = [(3, "p q r s t u"), (5, "p q r s t u"), (5, "other words stand in this text"), (5, "and again others are in that one"), (6, None), (None, "p q r s t u")]
    got = jaccard.linked(spark.createDataFrame(docs, "doc_id long, text string"), detail=True).join(spark.createDataFrame(docs, "doc_id long, text string").select(F.xxhash64("text").alias("text_hash"), "text").distinct(), "text_hash").collect()
    assert {(x["doc_id"], x["text"], x["component_id"]) for x in got} == {(3, docs[0][1], None), (5, docs[0][1], None), (None, docs[0][1], None), (5, docs[2][1], 5), (5, docs[3][1], 5), (6, None, 6)}
    assert len({x["component"] for x in got if x["text"] == docs[0][1]}) == 1 and len({x["component"] for x in got if x["text"]}) == 3


def base_rules(t):
    w, lines = BLANK.findall(t or ""), (t or "").split("\n")
    c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    cover = {p for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
    seen, dup = set(), 0
    for x in lines:
        if BLANK.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def test_quality_rules(spark):
    r = random.Random(12)
    good = [(1000 + k, sentence(r, 80)) for k in range(60)]
    junk = [(2000 + k, " ".join("qq" + str(r.randrange(9)) + "##" for _ in range(80))) for k in range(10)]
    odd = [(3000, "a b c d e f g h " * 5 + sentence(r, 20)), (3001, "\n".join(["x y"] * 5 + [" "] * 3)), (3002, "日本 🙂 " * 30)]
    docs = documents(spark, [(*x, *[None] * 11) for x in [*good, *junk, *odd]])
    lab = spark.createDataFrame([(i, 1) for i, _ in good[:50]] + [(i, 0) for i, _ in junk] + [(None, 1), (4, None)], "doc_id long, quality int")
    got = qrules.apply_rules(docs, lab).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((x["doc_id"], *(x[n] for n in names)) for x in got) == Counter((x["doc_id"], *base_rules(x["text"])) for x in docs.collect())
    kept = {x["doc_id"]: x["kept"] for x in got}
    assert all(kept[i] for i, _ in good) and not any(kept[i] for i, _ in junk) and not any(x["kept"] and x["base_failed"] for x in got)
    assert qrules.apply_rules(empty(spark), lab).count() == 0
    assert qrules.apply_rules(docs, lab.limit(0)).where("kept = base_failed").isEmpty()


def test_quality_classifier(spark):
    r = random.Random(13)
    docs = [(k, sentence(r, 60) if k % 3 else " ".join(w + r.choice(["%%%", "###", "!!"]) for w in sentence(r, 60).split())) for k in range(300)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)], "doc_id long, quality int")
    model = qclass.train(d, lab, use=~qclass.held_out())
    got = qclass.score(d, model).collect()
    assert all((x["score"] >= 0.3) == (x["doc_id"] % 3 > 0) for x in got)
    odd = qclass.score(documents(spark), model).collect()
    assert len(odd) == len(rows()) and all(0 <= x["score"] <= 1 for x in odd)
    assert qclass.score(empty(spark), model).count() == 0
    assert len({x["score"] for x in qclass.score(d, qclass.train(d, lab.where("quality = 1"))).collect()}) == 1


def test_trees_against_a_walk():
    r = np.random.default_rng(2)
    x = r.random((300, 4))
    m = qclass.fit(x, (x[:, 1] > x[:, 2]).astype(float), np.ones(300))
    for k in range(0, 300, 37):
        total = m.base
        for root in m.roots:
            at = root
            while m.left[at] != at:
                at = m.left[at] if x[k, m.feature[at]] <= m.threshold[at] else m.right[at]
            total += m.value[at]
        assert m.scores(x[k : k + 1])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_ngrams_of_few_sets_in_each_of_many_parts_are_dealt_by_salts(spark):
    """A shingle in two sets of each of 120 parts: no part knows it as frequent, and no group is larger than those that stay together."""
    r = random.Random(31)
    texts = [(k, "the very same four words " + sentence(r, 12)) for k in range(240)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(120)
    rows = docs.selectExpr("doc_id", "xxhash64(text) AS t", "text")
    send = spark.sparkContext.broadcast
    none = np.zeros(0, np.uint64)
    plain = jaccard._prefixes(rows, send(none), send(none), 4, 60)
    counted = plain.groupBy(F.col("token").alias("gram")).agg(F.count("*").alias("c"))
    crowded = jaccard._frequent(counted, jaccard.FREQUENT)
    assert len(crowded) and counted.agg(F.max("c")).first()[0] > 3 * jaccard.FREQUENT
    kept = jaccard._prefixes(rows, send(none), send(crowded), 4, 60)
    assert kept.where("not hot").groupBy("token").count().agg(F.max("count")).first()[0] < jaccard.FREQUENT
    assert kept.drop("hot").exceptAll(plain.drop("hot")).isEmpty() and kept.count() == plain.count()
    copies = [(1000 + k, texts[k][1] + " end") for k in range(0, 240, 3)]
    got = {x["doc_id"]: x["component_id"] for x in jaccard.linked(spark.createDataFrame([*texts, *copies], "doc_id long, text string").repartition(120), percent=60).collect()}
    assert all(got[1000 + k] == k for k in range(0, 240, 3))


def brute_licences(t, templates):
    """All units of the text's lines with words, for each template; of overlapping ones the best."""
    grams = lambda w: {*zip(w, w[1:], strict=False)}
    lines = [(k, w) for k, x in enumerate((t or "").split("\n")) if (w := re.findall("[a-z0-9]+", low(x)))]
    found = {}
    for name, y in templates:
        y = re.findall("[a-z0-9]+", low(y))
        m = grams(y)
        flat = [(k, x) for k, (_, w) in enumerate(lines) for x in w]
        for p in range(len(flat) - len(y) + 1):  # as many words in a row, wherever they begin
            o = grams([x for _, x in flat[p : p + len(y)]])
            if len(y) > 1 and (flat[p][1], flat[p + 1][1]) in m and 200 * len(o & m) >= 80 * (len(o) + len(m)):
                at = name, flat[p][0], flat[p + len(y) - 1][0]
                found[at] = max(found.get(at, 0), 200 * len(o & m) // (len(o) + len(m)))
        for a in range(len(lines)):
            z = a
            while z < len(lines) - 1 and sum(len(w) for _, w in lines[a : z + 1]) < len(y):
                z += 1
            for e in {a, z, max(a, z - 1)}:
                o = grams([x for _, w in lines[a : e + 1] for x in w])
                if m and o and 200 * len(o & m) >= 80 * (len(o) + len(m)):
                    found[name, a, e] = max(found.get((name, a, e), 0), 200 * len(o & m) // (len(o) + len(m)))
    key = lambda x: (-x[1], x[0][2] - x[0][1], x[0][1])
    out = [x for x in found.items() if not any(y[0][0] == x[0][0] and y[0][1] <= x[0][2] and x[0][1] <= y[0][2] and key(y) < key(x) for y in found.items())]
    return tuple(sorted((name, lines[a][0], z - a + 1, v) for (name, a, z), v in out))


def test_license_scan(spark):
    notice = {x: [t for n, t in licenses.NOTICES if n == x] for x, _ in licenses.NOTICES}
    wrap = lambda t, n, mark="": "\n".join(mark + " ".join(t.split()[k : k + n]) for k in range(0, len(t.split()), n))
    r = random.Random(15)
    texts = ["Released under the MIT License.", "x\n  released UNDER the mit licence, license.\ny", "All rights\nreserved.", "\n\nLicensed under\nCC BY-NC 4.0.\n\nText", "MIT", None, "", "All rights reserved. " * 3]
    texts += [notice["MIT"][1].replace(",", "\n"), notice["Apache-2.0"][1] + "\n" + notice["BSD"][0], "All rights reserved.\n" * 40, notice["GPL-3.0"][2].replace(". ", ".\n\n")]
    texts += ["\r\n \r\n".join([sentence(r, 20), wrap(notice["MIT"][2], 9, "// "), sentence(r, 20)]), sentence(r, 9) + "\n" + wrap(notice["BSD"][1], 12, " * ") + "\n" + sentence(r, 9), wrap(notice["BSD"][0], 11), sentence(r, 12) + "\n" + wrap(notice["ISC"][0], 7) + "\n" + sentence(r, 12)]
    texts += [wrap(notice["zlib"][0], 10), wrap(notice["zlib"][0].replace("software", "library"), 8), "\n".join([notice["MIT"][0], sentence(r, 4)] * 3)]
    texts += ["Copyright 2020 A. Author. Released under the MIT License.", "foo bar baz qux Licensed under the Apache License, Version 2.0.", sentence(r, 30) + " " + wrap(notice["BSD"][0], 9) + " " + sentence(r, 30), "The MIT License. All rights reserved. " * 5]
    docs = documents(spark, [(900 + k, t, *[None] * 11) for k, t in enumerate(texts)])
    got = licenses.scan(docs, licenses.notices(spark)).collect()
    assert Counter((x["doc_id"], tuple(tuple(m) for m in x["matches"])) for x in got) == Counter((x["doc_id"], brute_licences(x["text"], licenses.NOTICES)) for x in docs.collect())
    found = {x["doc_id"]: {m["license"] for m in x["matches"]} for x in got}
    for k, name in ((2, "proprietary"), (3, "CC-BY-NC-4.0"), (11, "GPL-3.0"), (12, "MIT"), (13, "BSD"), (14, "BSD"), (15, "ISC"), (16, "zlib"), (17, "zlib"), (19, "MIT"), (20, "Apache-2.0"), (21, "BSD")):
        assert name in found[900 + k], name
    assert licenses.scan(empty(spark), licenses.notices(spark)).count() == 0
    assert licenses.scan(docs, licenses.notices(spark).limit(0)).where("size(matches) > 0").isEmpty()
    two = [("own", notice["zlib"][0] + "\n\n" + notice["ISC"][0])]  # a template of two paragraphs, and a text that is just it
    same = spark.createDataFrame([(1, two[0][1])], "doc_id long, text string")
    assert licenses.scan(same, spark.createDataFrame(two, "license string, text string")).first()["matches"][0]["dice"] == 100


def test_license_scan_by_few_lines_at_a_time(spark, monkeypatch):
    r = random.Random(16)
    notice = [t for _, t in licenses.NOTICES]
    words = " ".join(notice).split()
    texts = ["\n".join(" ".join(r.choice([w, w, "other"]) for w in words[k : k + r.randrange(1, 12)]) for k in range(0, 900, 9)) for _ in range(6)] + ["\n".join(sentence(r, 5) for _ in range(40)) + "\n" + "\n".join(notice[4].split()) + "\nend"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for n in (1, 7, 256):
        monkeypatch.setattr(licenses, "LINES", n)
        got = {x["doc_id"]: tuple(tuple(m) for m in x["matches"]) for x in licenses.scan(docs, licenses.notices(spark)).collect()}
        assert got == {k: brute_licences(t, licenses.NOTICES) for k, t in enumerate(texts)}


def test_license_scan_checks_all_templates(spark):
    # 62 bytes of bigrams each: 65,536 of them would be under the limit
    many = spark.range(70_000).select(F.lit("own").alias("license"), F.concat(F.lit("own notice "), F.lpad(F.col("id").cast("string"), 45, "0")).alias("text"))
    with pytest.raises(ValueError):
        licenses.scan(documents(spark), many)


def test_token_counts(spark):
    r = random.Random(14)
    pieces = {c: -10.0 - k for k, c in enumerate("▁abcd")}
    for _ in range(60):
        p = "".join(r.choices("abcd", k=r.randrange(2, 6)))
        pieces[r.choice(["", "▁"]) + p] = -round(r.random() * 15, 3)
    model = tokencount.Unigram(list(pieces.items()))

    def brute(w):
        best = [(0.0, 0)]
        for e in range(1, len(w) + 1):
            options = [(best[a][0] + pieces[w[a:e]], best[a][1] + 1) for a in range(max(0, e - model.longest), e) if w[a:e] in pieces]
            if w[e - 1] not in pieces:
                options.append((best[e - 1][0] + model.unknown, best[e - 1][1] + len(w[e - 1].encode())))
            top = max(o[0] for o in options)
            best.append(next(o for o in options if o[0] == top))
        return best[-1][1]

    ws = list({"▁" * r.randrange(0, 3) + "".join(r.choices("abcdéx🙂", k=r.randrange(1, 9))) for _ in range(400)})
    assert model.counts(ws).tolist() == [brute(w) for w in ws]
    docs = documents(spark)
    got = Counter((x["doc_id"], x["n_tokens"]) for x in tokencount.token_counts(docs, list(pieces.items())).collect())
    assert got == Counter((x["doc_id"], sum(brute(w) for w in re.findall("▁*[^▁]+|▁+", "▁" + x["text"].replace(" ", "▁"))) if x["text"] else 0) for x in docs.collect())
    assert tokencount.token_counts(empty(spark), list(pieces.items())).count() == 0
    with pytest.raises(ValueError):
        tokencount.Unigram([("a▁b", -1.0)])


def test_digest_of_items(spark):
    df = spark.createDataFrame([(["10", "2"],), ([],)], "x array<string>")
    assert [r[0] for r in df.select(decontaminate.item_digest(F.col("x"))).collect()] == [hashlib.sha256(b"10,2").hexdigest(), hashlib.sha256(b"").hexdigest()]
