"""Very long texts, with and without blanks and line ends, among short ones: taken whole by every operator."""

import random

import numpy as np
import pyarrow as pa
import pytest

from gammaweave.llm import bpe, decontaminate, jaccard, langid, licenses, linededup, qclass, qrules, tokencount, toxicity
from gammaweave.llm.text import ALNUM, words

from .common import sentence


@pytest.fixture(scope="module")
def texts():
    r = random.Random(91)
    lines = "\n".join(sentence(r, 9) for _ in range(12_000))  # 600,000 characters
    notice = licenses.NOTICES[1][1]
    return [(1, lines + "\n" + notice), (2, "ab" * 150_000), (3, sentence(r, 60_000)), (4, "Short text"), (5, lines), (6, None), (7, "")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(3)


def test_words_and_windows(spark, docs, texts):
    w = words(pa.array([t for _, t in texts], pa.string()), ALNUM).counts().tolist()
    item = " ".join(texts[2][1].split()[59_950:])
    got = {x["doc_id"]: x for x in decontaminate.contamination(docs, spark.createDataFrame([("a", item), ("b", texts[4][1])], "item_id string, text string"), block_words=20_000).collect()}
    assert [got[k]["n_words"] for k, _ in texts] == w
    assert got[3]["item_ids"] == ["a"] and got[3]["n_hit"] == 50 and got[5]["n_hit"] == w[4] and got[1]["n_hit"] >= w[4] and got[2]["n_hit"] == 0


def test_models(spark, docs, texts):
    small = spark.createDataFrame([(k, sentence(random.Random(k), 30), "en" if k % 2 else "de") for k in range(60)], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(k, k % 2, k % 2) for k in range(60)], "doc_id long, toxic int, quality int")
    for out in (toxicity.score(docs, toxicity.train(small, lab)), qclass.score(docs, qclass.train(small, lab)), langid.label(docs, langid.train(small))):
        got = {x["doc_id"]: x["score"] for x in out.collect()}
        assert len(got) == len(texts) and all(0 <= v <= 1 for v in got.values())
    assert langid.label(docs, langid.train(docs.selectExpr("doc_id", "text", "CASE doc_id WHEN 3 THEN 'xx' WHEN 1 THEN 'yy' END AS lang"))).where("doc_id = 3").first()["lang_pred"] in ("xx", "yy")
    rules = {x["doc_id"]: x for x in qrules.apply_rules(docs, lab).collect()}
    assert [rules[k]["n_words"] for k, _ in texts] == [len((t or "").split()) for _, t in texts] and rules[2]["word_chars"] == 300_000


def test_lines_sets_and_notices(spark, docs, texts):
    found = {x["doc_id"]: x for x in linededup.line_report(docs).collect()}
    assert [tuple(x) for x in found[5]["runs"]] == [(0, 12_000, 1, 0)] and len(found[5]["removed"]) == 12_000 and not found[1]["removed"]
    linked = {x["doc_id"]: x["component_id"] for x in jaccard.linked(docs).collect()}
    assert linked == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 6, 7: 7}
    got = {x["doc_id"]: [(m["license"], m["line"]) for m in x["matches"]] for x in licenses.scan(docs, licenses.notices(spark)).collect()}
    assert got == {k: [("Apache-2.0", 12_000)] if k == 1 else [] for k, _ in texts}


def test_notices_after_very_many_lines(spark):
    """300,000 lines of a word, then a long notice, wrapped; and the notice 400 times."""
    notice = licenses.NOTICES[4][1]
    wrapped = "\n".join(" ".join(notice.split()[k : k + 9]) for k in range(0, len(notice.split()), 9))
    texts = spark.createDataFrame([(1, "\n".join(["word"] * 300_000) + "\n" + wrapped), (2, "\n".join([wrapped] * 400)), (3, "word " * 300_000 + notice)], "doc_id long, text string")
    got = {x["doc_id"]: [(m["license"], m["line"]) for m in x["matches"]] for x in licenses.scan(texts.repartition(3), licenses.notices(spark)).collect()}
    assert ("BSD", 300_000) in got[1] and ("BSD", 0) in got[3] and sum(k == "BSD" for k, _ in got[2]) >= 400


def test_tokens(spark, docs, texts):
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = {x["doc_id"]: x for x in bpe.encode(docs, path, P.PATTERN, decode=True).collect()}
    assert all(bytes(got[k]["decoded"]) == (t or "").encode() and got[k]["n_tokens"] == len(np.frombuffer(got[k]["ids"], "<u4")) for k, t in texts)
    pieces = [("▁", -1.0), ("a", -2.0), ("b", -2.5), ("ab", -3.0), ("abab", -5.0)]
    counts = {x["doc_id"]: x["n_tokens"] for x in tokencount.token_counts(docs, pieces).collect()}
    assert counts[2] == 1 + 75_000 and counts[6] == counts[7] == 0
