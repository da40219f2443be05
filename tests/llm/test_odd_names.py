"""Columns of documents whose names clash with those the operators make, or can't be written without quotes."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from gammaweave.llm import bpe, decontaminate, langid, linededup, qclass, qrules, tokencount, toxicity
from tests.conftest import DATA

from .common import documents

ODD = ["n_hit", "n_words", "item_ids", "spans", "a.b", "back`tick", "k_0", "d", "t", "_doc", "_t", "removed_", "runs", "lines", "lang_pred", "N_TOKENS", "ids", "kept", "x y"]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark).select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(c).alias(c) for c in ODD))


def test_stages(spark, odd):
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, odd, str(DATA))
        assert out.columns == odd.columns, name
        assert {r["a.b"] for r in out.collect()} == {"a.b"}, name
    assert P.STAGES[-1][1](spark, odd, str(DATA)).count() == odd.count()


def test_kept_columns(spark, odd):
    import public_tokenizers

    labels, keep = spark.read.parquet(f"{DATA}/labels.parquet"), tuple(odd.columns)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for out, own in (
        (decontaminate.contamination(odd, spark.read.parquet(f"{DATA}/benchmark.parquet"), keep=keep), "n_hit"),
        (toxicity.score(odd, toxicity.train(docs, labels), keep=keep), "score"),
        (langid.label(odd, langid.train(docs), keep=keep), "lang_pred"),
        (qclass.score(odd, qclass.train(docs, labels), keep=keep), "score"),
        (bpe.encode(odd, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=keep), "n_tokens"),
        (tokencount.token_counts(odd, [("a", -1.0), ("b", -2.0)], keep=keep), "n_tokens"),
        (qrules.apply_rules(odd, labels, keep=keep), "kept"),
    ):
        assert len(out.columns) == len({c.lower() for c in out.columns}) and own in out.columns
        rows = out.collect()
        assert len(rows) == odd.count() and all(r["back`tick"] == "back`tick" for r in rows)
    assert linededup.dedup_lines(odd).columns == odd.columns
