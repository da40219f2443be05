"""Queries of the corpus operators: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination, item_digest

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), item_digest(F.col("item_ids")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out, score, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), use=~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, label, train

    docs = table(spark, sf_dir, "documents")
    return label(docs, train(docs, use=~held_out())).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import line_report

    found = line_report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"),
                        F.size("runs").cast("long").alias("n_runs"), F.coalesce(F.array_max(F.transform("runs", lambda x: x["n_lines"])), F.lit(0)).cast("long").alias("longest_run"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode

    done = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import linked

    return linked(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .qrules import apply_rules

    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .qclass import held_out, score, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), use=~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import notices, scan

    m = F.col("matches")
    found = scan(table(spark, sf_dir, "documents"), notices(spark))
    return found.select("doc_id", F.size(m).cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["license"]))), ",").alias("licenses"),
                        F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["license"], x["line"].cast("string"), x["n_lines"].cast("string"))), ",").alias("units"),
                        F.coalesce(F.array_max(F.transform(m, lambda x: x["dice"])), F.lit(0)).cast("long").alias("best_dice"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokencount import load, token_counts

    return token_counts(table(spark, sf_dir, "documents"), load(public_tokenizers.path("piece_bpe_32k.model")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import periodic_runs, with_periodic_tails

    found = periodic_runs(with_periodic_tails(table(spark, sf_dir, "documents")))
    stronger = "b IS NULL OR r.length * b.period > b.length * r.period"  # of equally strong ones the first, as runs go by start and period
    found = found.selectExpr("*", f"aggregate(runs, CAST(NULL AS struct<start:long,length:long,period:long>), (b, r) -> CASE WHEN {stronger} THEN r ELSE b END) AS best")
    lines = "concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, chr(10))))"
    return found.selectExpr("doc_id", "CAST(size(runs) AS BIGINT) AS n_runs", "best.start", "best.length", "best.period", "1000 * best.length div best.period AS exponent_milli",
                            f"sha2({lines}, 256) AS runs_sha256", "sha2(collapsed, 256) AS collapsed_sha256")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster

    done = cluster(table(spark, sf_dir, "embeddings"), 16, 3)
    return done.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imatch import edited_and_next

    return edited_and_next(table(spark, sf_dir, "documents"))


_ALL = (
    op1_decontamination, op2_toxicity, op3_language_id, op4_line_dedup, op5_byte_bpe, op6_ngram_jaccard, op7_quality_rules, op8_quality_classifier, op9_license_scan,
    op10_token_counts, op11_periodic_runs, op12_centroid_clustering, op13_document_fingerprints,
)
QUERIES = {f.__name__: f for f in _ALL}
#: Stretches of 20 characters, line ends included, from each line on and up to each line; a line goes if it is in a later copy of one. Stretches that adjoin, as their first copies do, are a run.
_OP4 = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
           FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, pos, line, least(length(line) + 1, 20) AS w, sum(least(length(line) + 1, 20)) OVER (PARTITION BY doc_id ORDER BY pos) AS c FROM l),
e AS (SELECT doc_id, pos, c, c - w AS b,
        last(pos) OVER f AS e1, last(c) OVER f AS c1, first(pos) OVER g AS s2, first(c - w) OVER g AS b2
      FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY c - w RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING),
                    g AS (PARTITION BY doc_id ORDER BY c RANGE BETWEEN 19 PRECEDING AND CURRENT ROW)),
s AS (SELECT doc_id, pos AS a, e1 AS z FROM e WHERE c1 - b >= 20 UNION SELECT doc_id, s2, pos FROM e WHERE c - b2 >= 20),
k AS (SELECT s.*, array_to_string(list_slice(string_split(d.text, chr(10)), a + 1, z + 1), chr(10)) AS body FROM s JOIN documents d USING (doc_id)),
o AS (SELECT *, row_number() OVER q AS n, first_value(doc_id) OVER q AS fd, a - first_value(a) OVER q AS shift FROM k WINDOW q AS (PARTITION BY body ORDER BY doc_id, a)),
i AS (SELECT *, sum(CASE WHEN before >= a - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, fd, shift ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
      FROM (SELECT *, max(z) OVER (PARTITION BY doc_id, fd, shift ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o WHERE n > 1)),
g AS (SELECT doc_id, count(*) AS n_runs, max(size) AS longest FROM (SELECT doc_id, fd, shift, run, max(z) - min(a) + 1 AS size FROM i GROUP BY ALL) GROUP BY doc_id),
r AS (SELECT DISTINCT doc_id, unnest(generate_series(a, z)) AS pos FROM o WHERE n > 1),
x AS (SELECT doc_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS p FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(x.n, 0) AS BIGINT) AS n_removed, coalesce(x.p, '') AS removed_lines,
  CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(coalesce(longest, 0) AS BIGINT) AS longest_run
FROM documents d LEFT JOIN x USING (doc_id) LEFT JOIN g USING (doc_id)
"""


def _op9() -> str:
    """Texts and templates whose common bigrams are enough for any unit, then all units of the text's lines with words, and as many words in a row as the template has from each of its bigrams on; s and f: a line's first word, and the one after its last."""
    from .licenses import NOTICES

    rows = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in NOTICES)
    words = lambda x: f"list_filter(regexp_split_to_array(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> '')"
    grams = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    return f"""
WITH n(license, text) AS (VALUES {rows}),
tw AS (SELECT license, {words('text')} AS w FROM n), t AS (SELECT row_number() OVER () AS template, license, len(w) AS size, {grams('w')} AS g FROM tw),
dw AS (SELECT doc_id, {words('text')} AS w FROM documents WHERE text IS NOT NULL), dg AS (SELECT doc_id, w, {grams('w')} AS g FROM dw WHERE len(w) > 1),
c AS MATERIALIZED (SELECT doc_id, template, license, size, dg.w, t.g FROM dg, t WHERE 120 * len(list_intersect(dg.g, t.g)) >= 80 * len(t.g)),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents SEMI JOIN c USING (doc_id)),
l1 AS (SELECT doc_id, line, len({words('x')}) AS k FROM l0), l2 AS (SELECT *, sum(k) OVER p AS f, row_number() OVER p - 1 AS a, sum(k) OVER (PARTITION BY doc_id) AS total FROM l1 WHERE k > 0 WINDOW p AS (PARTITION BY doc_id ORDER BY line)),
l AS MATERIALIZED (SELECT *, f - k AS s FROM l2),
e AS (SELECT c.*, x.a, x.line, x.s, y.a AS z FROM c JOIN l x USING (doc_id) JOIN l y ON y.doc_id = x.doc_id AND y.s <= least(x.s + size, x.total) - 1 AND least(x.s + size, x.total) - 1 < y.f),
u AS (SELECT DISTINCT * FROM (SELECT doc_id, template, a, unnest([a, z, greatest(a, z - 1)]) AS z FROM e)),
v AS (SELECT u.*, e.license, e.line, e.g, e.w[CAST(e.s AS BIGINT) + 1:CAST(y.f AS BIGINT)] AS w FROM u JOIN e USING (doc_id, template, a) JOIN l y ON y.doc_id = u.doc_id AND y.a = u.z),
r AS (SELECT *, unnest(range(0, len(w) - size + 1)) AS p FROM c WHERE len(w) >= size),
q AS (SELECT r.doc_id, r.license, x.line, x.a, y.a AS z, r.g, r.w[CAST(p AS BIGINT) + 1:CAST(p AS BIGINT) + size] AS w FROM (FROM r WHERE list_contains(g, w[p + 1] || ' ' || w[p + 2])) r
      JOIN l x ON x.doc_id = r.doc_id AND x.s <= p AND p < x.f JOIN l y ON y.doc_id = r.doc_id AND y.s <= p + size - 1 AND p + size - 1 < y.f),
vg AS (SELECT doc_id, license, line, a, z, g, {grams('w')} AS o FROM (SELECT doc_id, license, line, a, z, g, w FROM v UNION ALL FROM q) WHERE len(w) > 1),
m AS (SELECT doc_id, license, line, a, z, max((200 * len(list_intersect(o, g))) // (len(o) + len(g))) AS dice FROM vg WHERE 200 * len(list_intersect(o, g)) >= 80 * (len(o) + len(g)) GROUP BY ALL),
b AS (SELECT * FROM m WHERE NOT EXISTS (FROM m o WHERE o.doc_id = m.doc_id AND o.license = m.license AND o.a <= m.z AND m.a <= o.z AND (o.dice > m.dice OR o.dice = m.dice AND (o.z - o.a < m.z - m.a OR o.z - o.a = m.z - m.a AND o.a < m.a)))),
x AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS l, string_agg(license || ':' || line || ':' || z - a + 1, ',' ORDER BY license, line) AS s, max(dice) AS d FROM b GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, coalesce(l, '') AS licenses, coalesce(s, '') AS units, CAST(coalesce(x.d, 0) AS BIGINT) AS best_dice FROM documents d LEFT JOIN x USING (doc_id)
"""


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP1 = rf"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda k: array_to_string(w[k:k + least(10, len(w)) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS g FROM d, (SELECT DISTINCT n FROM iw)),
h AS (SELECT doc_id, k, n, item FROM dw JOIN iw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
_OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') END AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))) END AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(c) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, g
"""


def _op12() -> str:
    """Three rounds and one more assignment, all pairs of vectors and centroids: c0 to c3 are centroids, d0 to d3 distances, a0 to a3 assignments."""
    floor = "CAST((s - ((s % n) + n) % n) / n AS BIGINT)".replace(" / ", " // ")
    parts = []
    for r in range(4):
        parts.append(f"d{r} AS (SELECT vec_id, cluster, sum((q.x - c.x) * (q.x - c.x)) AS d FROM q JOIN c{r} c USING (dim) GROUP BY vec_id, cluster)")
        parts.append(f"a{r} AS (SELECT vec_id, min(d) AS distance, arg_min(cluster, (d, cluster)) AS cluster FROM d{r} GROUP BY vec_id)")
        if r < 3:
            parts.append(f"s{r} AS (SELECT cluster, dim, sum(x) AS s, count(*) AS n FROM q JOIN a{r} USING (vec_id) GROUP BY cluster, dim)")
            parts.append(f"c{r + 1} AS (SELECT cluster, dim, coalesce({floor}, x) AS x FROM c{r} LEFT JOIN s{r} USING (cluster, dim))")
    return f"""
WITH k AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
q AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, unnest(range(64)) AS dim FROM k),
h AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster FROM k),
c0 AS (SELECT cluster, dim, x FROM h JOIN q USING (vec_id) WHERE cluster < 16),
{", ".join(parts)},
i AS (SELECT cluster, sum(distance) AS n FROM a3 GROUP BY cluster), t AS (SELECT cluster, string_agg(CAST(x AS VARCHAR), ',' ORDER BY dim) AS x FROM c3 GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INT) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(i.n AS BIGINT) AS cluster_inertia, CAST((SELECT sum(n) FROM i) AS BIGINT) AS inertia,
  sha256(t.x) AS centroid_sha256
FROM a3 JOIN i USING (cluster) JOIN t USING (cluster)
"""


ORACLES: dict[str, str] = {"op12_centroid_clustering": _op12(), "op1_decontamination": _OP1, "op6_ngram_jaccard": _OP6, "op9_license_scan": _op9(), "op4_line_dedup": _OP4}
