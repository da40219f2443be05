r"""Quality rules: counts of each text, and the log-likelihood ratio of its hashed n-grams. DataFrame operations only.

The n-grams are words and pairs of consecutive words, hashed to BUCKETS buckets. Two multinomials with additive smoothing are
estimated: a raw one from all documents, and a trusted one from all documents labelled good. A
document's verdict is the mean log ratio over its n-grams against a threshold: so many standard deviations below the mean of all trusted documents, each
taken by the counts of the half of them that it isn't in. Log ratios are whole numbers of 2**-20, and what is summed is whole, so the same input gives the same verdicts in whatever order it is read.

Words are maximal runs of characters other than \x20 and \x09-\x0D. The counts of one text are computed in its own row. Its n-grams meet the ratios, a table of
BUCKETS rows, by a broadcast join, and are summed within the task before anything is shuffled: a narrow row for each document.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import carried, column, label_rows, restored
from .shared import scratch

BUCKETS, MOST_LABELS = 1 << 18, 1 << 20
SMOOTH, DEVIATIONS = 0.5, 4.0
UNIT, RUN = 1 << 20, 8
_SYMBOLS = "[#*$%&|<>]"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def n_dup_lines(text: Column) -> Column:
    r"""\n-split lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.size(lines) - F.size(F.array_distinct(lines))


def _joined(column: str, step: int) -> Column:
    """Hashes of each element with the one `step` places on."""
    n = F.greatest(F.size(column) - step, F.lit(0))
    return F.zip_with(F.slice(column, 1, n), F.slice(column, step + 1, n), lambda a, b: F.xxhash64(a, b))


def with_repeats(rows: DataFrame, out: str) -> DataFrame:
    """Adds out: how many words lie in windows of RUN words that the text has twice or more. Needs _h, the words' hashes."""
    rows = rows.withColumn("_h2", _joined("_h", 1)).withColumn("_h4", _joined("_h2", 2)).withColumn("_w", _joined("_h4", 4))
    repeats = F.size(F.array_distinct("_w")) < F.size("_w")
    entry = F.transform("_w", lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    rows = rows.withColumn("_s", F.when(repeats, F.array_sort(entry)))
    same = F.filter("_s", lambda x, k: ((k > 0) & (F.get("_s", k - 1)["h"] == x["h"])) | (F.coalesce(F.get("_s", k + 1)["h"] == x["h"], F.lit(False))))
    rows = rows.withColumn("_p", F.array_sort(F.transform(same, lambda x: x["i"])))
    steps = F.zip_with(F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), F.slice("_p", 1, F.greatest(F.size("_p") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(RUN)))
    covered = F.when(F.col("_p").isNull() | (F.size("_p") == 0), 0).otherwise(F.aggregate(steps, F.lit(RUN), lambda m, v: m + v))
    return rows.withColumn(out, covered.cast("long"))


def grams(rows: DataFrame, *keep: str, buckets: int = BUCKETS) -> DataFrame:
    """keep, chars, b1 and b2 for each of the words ws: its code points, its bucket, and that of the pair that begins there (null for the last word)."""
    pairs = "inline(arrays_zip(ws, slice(ws, 2, greatest(size(ws) - 1, 0)))) AS (a, b)"
    return rows.where("size(ws) > 0").selectExpr(*keep, pairs).selectExpr(*keep, "char_length(a) AS chars", f"xxhash64(a) & {buckets - 1}L AS b1", f"CASE WHEN b IS NOT NULL THEN xxhash64(xxhash64(a), xxhash64(b)) & {buckets - 1}L END AS b2")


def log_ratios(documents: DataFrame, trusted: DataFrame, *, text: str = "text", doc: str = "doc_id", buckets: int = BUCKETS, small: bool = True) -> DataFrame:
    """(b, w): for each bucket that documents have, the log ratio of the trusted (doc_id) to the raw multinomial, in units of 1 / UNIT. small: trusted may be broadcast.

    If trusted has half (0 or 1), also w0 and w1: the ratios that those of half 0, or 1, are judged by, from the trusted of the other half only.
    """
    halves = "half" in trusted.columns
    good = trusted.select(F.col("doc_id").alias("_id"), (F.col("half") if halves else F.lit(1)).alias("_good"))
    of = {"w": "good"} | ({"w0": "good1", "w1": "good0"} if halves else {})
    rows = documents.select(column(doc).alias("_doc"), words(column(text)).alias("ws")).join(F.broadcast(good) if small else good, F.col("_doc") == F.col("_id"), "left")
    each = grams(rows, "_good", buckets=buckets).selectExpr("_good", "explode(array(b1, b2)) AS b").where("b is not null")
    by_half = [F.count(F.when(F.col("_good") == k, 1)).alias(f"good{k}") for k in (0, 1)] if halves else []
    counts = scratch(documents.sparkSession)(each.groupBy("b").agg(F.count("*").alias("raw"), F.count("_good").alias("good"), *by_half))
    raw, *own = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("raw", *of.values()))).first()
    share = lambda n, total: (F.col(n) + SMOOTH) / F.lit(total + SMOOTH * buckets)
    return counts.select("b", *(F.round((F.log(share(c, total)) - F.log(share("raw", raw))) * UNIT).cast("long").alias(w) for (w, c), total in zip(of.items(), own, strict=True)))


def summed(rows: DataFrame, ratios: DataFrame, *keys: str, buckets: int = BUCKETS) -> DataFrame:
    """keys, total, words, pairs and chars: the sum of the log ratios of the words ws and their pairs, how many there are of either, and the words' code points, of each of k rows
    that share their keys (each sum k times). With ratios by halves (and _half a key), also apart: the sum of the ratios that the half is judged by, null without a half."""
    names = [c for c in ratios.columns if c != "b"]
    one = lambda k: F.broadcast(ratios.select(F.col("b").alias(f"b{k}"), *(F.col(c).alias(f"{c}_{k}") for c in names)))  # noqa: E731; BUCKETS rows at most
    met = grams(rows, *keys, buckets=buckets).join(one(1), "b1", "left").join(one(2), "b2", "left")
    both = lambda w: F.coalesce(f"{w}_1", F.lit(0)) + F.coalesce(f"{w}_2", F.lit(0))
    judged = [F.sum(F.when(F.col("_half") == 0, both("w0")).when(F.col("_half") == 1, both("w1"))).alias("apart")] if "w0" in names else []
    return met.groupBy(*keys).agg(F.sum(both("w")).alias("total"), *judged, F.count("b1").alias("words"), F.count("b2").alias("pairs"), F.sum("chars").alias("chars"))


#: A text's mean log ratio in millionths, towards 0.
_MEAN = f"CAST({{}} * 1000000BD / ((words + pairs) * {UNIT}BD) AS BIGINT)"


def threshold(spark: SparkSession, means: DataFrame, deviations: float) -> int | None:
    """So many standard deviations under the mean of r; None without rows. The sums are whole numbers."""
    n, total, square = means.agg(F.count("r"), F.sum(F.col("r").cast("decimal(38,0)")), F.sum((F.col("r") * F.col("r")).cast("decimal(38,0)"))).first()
    if not n:
        return None
    total, square = int(total), int(square)
    return int(total / n - deviations * sqrt(max(0, n * square - total * total)) / n)


def apply_rules(documents: DataFrame, labels: DataFrame, *, text: str = "text", doc: str = "doc_id", label: str = "quality", keep: tuple[str, ...] = ("doc_id",),
                buckets: int = BUCKETS, apart: int | None = None, deviations: float = DEVIATIONS, least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """documents' columns keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_ratio and kept.

    base_failed: fewer than least_words words, or more than most_repeated percent of them in windows of 8 words found twice or more.
    kept: not base_failed, and log_ratio no less than the threshold. With apart, so many trusted documents at most make the threshold, and the counts are of the others only. Null and empty texts have no words, a log ratio of 0, and fail; without trusted
    documents no text fails by its ratio; repeated rows each give a row and equal results; a very long text is taken whole; no rows give none;
    other columns are not read, and one of keep that has a result's name gets _ at its end.
    """
    spark = documents.sparkSession
    store = scratch(spark)
    good = store(label_rows(labels, label, doc).where("label = 1").select("doc_id", F.xxhash64("doc_id", F.lit(3)).alias("h")))
    if apart is None:
        trusted, tried = good.selectExpr("doc_id", "CAST(pmod(h, 2) AS INT) AS half"), good
    else:
        tried = store(good.where("pmod(h, 2) = 0").orderBy("h", "doc_id").limit(apart).select("doc_id"))
        trusted = good.join(F.broadcast(tried), "doc_id", "left_anti")
    small = good.count() <= MOST_LABELS
    ratios = store(log_ratios(documents, trusted, text=text, doc=doc, buckets=buckets, small=small))
    kept = [column(c).alias(f"k_{i}") for i, c in enumerate(keep)]
    texts = documents.select(*kept, column(doc).alias("_doc"), F.xxhash64(column(text).cast("string")).alias("_t"), column(text).cast("string").alias("_text")).withColumn("ws", words(F.col("_text")))
    halves = tried.select(F.col("doc_id").alias("_id"), (F.expr("CAST(pmod(h, 2) AS INT)") if apart is None else F.lit(-1)).alias("_half"))
    own = texts.select("_doc", "_t", "ws").join(F.broadcast(halves) if small else halves, F.col("_doc") == F.col("_id"), "left")
    totals = store(summed(own, ratios, "_doc", "_t", "_half", buckets=buckets))
    # texts of so many words; one text stands once or more, words - pairs times
    judged = totals.where(f"_half IS NOT NULL AND words >= {least_words} * (words - pairs)")
    least = threshold(spark, judged.selectExpr(f"{_MEAN.format('apart' if apart is None else 'total')} AS r"), deviations)
    totals = totals.selectExpr("_doc AS _d", "_t AS _u", f"{_MEAN.format('total')} AS _r", "chars div (words - pairs) AS _chars")
    rows = texts.select(*carried(keep), "_doc", "_t", "ws", F.size("ws").cast("long").alias("n_words"),
                        F.regexp_count(F.coalesce("_text", F.lit("")), F.lit(_SYMBOLS)).cast("long").alias("n_symbols"), n_dup_lines(F.col("_text")).cast("long").alias("n_dup_lines"))
    rows = with_repeats(rows.withColumn("_h", F.transform("ws", lambda x: F.xxhash64(x))).drop("ws"), "n_repeat_words")
    rows = rows.withColumn("base_failed", F.expr(f"n_words < {least_words} or 100 * n_repeat_words > {most_repeated} * n_words")).drop("_h", "_h2", "_h4", "_w", "_s", "_p")
    rows = rows.join(totals, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_u")), "left").withColumns({"_r": F.coalesce("_r", F.lit(0)), "word_chars": F.coalesce("_chars", F.lit(0).cast("long"))})
    verdict = F.lit(True) if least is None else F.col("_r") >= F.lit(least)
    rows = rows.withColumns({"log_ratio": F.col("_r") / 1e6, "kept": ~F.col("base_failed") & verdict})
    return restored(rows, keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ratio", "kept")
