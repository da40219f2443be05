"""Repeated runs of lines, by distributed prefix doubling over line ids. DataFrame operations only.

All documents' lines, in the order of (document, place), are one sequence of ids. Only lines that occur twice take part; the others
end a run. Prefix doubling gives each place, for k = 0, 1, ..., the rank of the 2**k lines from there on in the order of the
suffixes: a range-partitioned sort of the distinct pairs of earlier ranks, whose numbers keep the order. Places of equal rank
are an interval of the suffix array with a common prefix of 2**k lines; two overlapping ranks name one of any other length. A place that is
alone in its interval is tied with none, and takes no part in what is longer.

A repeated run counts from MIN_CHARS characters (line ends included), so a line of a few words counts alone, and shorter ones with their
neighbours. A line lies in a later copy of a maximal run of at least
that size exactly if it does in a later copy of a shortest stretch of that size that begins at, or ends with, some line; so
doubling goes only as far as the longest of these (MIN_CHARS lines at most, each having its line end), however long the runs are. Stretches
that follow each other in a document, and whose first copies follow each other just so, make one maximal run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import column
from .shared import scratch

MIN_CHARS = 20


def _lines(docs: DataFrame, most: int) -> DataFrame:
    """A row for each line: two hashes for its id, and its weight, at most `most`."""
    entry = lambda x: F.struct(F.xxhash64(x).alias("h"), F.hash(F.lit(7), x).alias("g"), F.least(F.char_length(x) + 1, F.lit(most)).alias("w"))
    return docs.select("doc", "t", F.posexplode(F.transform(F.split("text", "\n"), entry)).alias("pos", "l")).select("doc", "t", "pos", "l.h", "l.g", "l.w")


def _numbers(rows: DataFrame, columns: list[str], name: str, store) -> DataFrame:
    """The rows of the columns that occur twice or more, with numbers that keep their order."""
    return store(rows.groupBy(*columns).count().where("count > 1").select(*columns).repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn(name, F.monotonically_increasing_id()))


def _rank(m: Column, top: int, prefix: str) -> Column:
    """The rank at the largest level that m lines hold."""
    out = F.col(f"{prefix}0")
    for k in range(1, top + 1):
        out = F.when(m >= 2**k, F.col(f"{prefix}{k}")).otherwise(out)
    return out


def _stretches(active: DataFrame, least: int) -> DataFrame:
    """(doc, t, start, m): the shortest stretches of lines of weight `least` from each line on and up to each line."""
    doc = Window.partitionBy("doc", "t")
    broken = F.when(F.col("pos") - F.lag("pos").over(doc.orderBy("pos")) == 1, 0).otherwise(2 * least)  # no stretch goes over a gap
    rows = active.select("doc", "t", "pos", "w", broken.alias("gap"))
    rows = rows.withColumn("c", F.sum(F.col("w") + F.col("gap")).over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.col("c") - F.col("w"))
    ahead, back = doc.orderBy("b").rangeBetween(0, least - 1), doc.orderBy("c").rangeBetween(1 - least, 0)
    rows = rows.select("doc", "t", "pos", "b", "c", F.last("pos").over(ahead).alias("end"), F.last("c").over(ahead).alias("end_c"), F.first("pos").over(back).alias("start"), F.first("b").over(back).alias("start_b"))
    both = F.array(F.when(F.expr(f"end_c - b >= {least}"), F.struct(F.col("pos").alias("start"), F.expr("end - pos + 1").alias("m"))), F.when(F.expr(f"c - start_b >= {least}"), F.struct(F.col("start"), F.expr("pos - start + 1").alias("m"))))
    return rows.select("doc", "t", F.explode(F.array_distinct(F.filter(both, lambda x: x.isNotNull()))).alias("s")).select("doc", "t", "s.start", "s.m")


def _many(rows: DataFrame) -> DataFrame:
    """Rows of lines, marked for a merge join: written, they take few bytes each (ids and texts' hashes repeat), so Spark would take millions of them for few and send them through the driver."""
    return rows.hint("merge")


def _null_safe(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """An inner join on doc (which may be null), t and the column, each of which stays once."""
    r = right.select(F.col("doc").alias("_d"), F.col("t").alias("_t"), F.col(column).alias("_c"), *(c for c in right.columns if c not in ("doc", "t", column)))
    return left.join(_many(r), F.col("doc").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")) & (F.col(column) == F.col("_c"))).drop("_d", "_t", "_c")


def _texts(documents: DataFrame, text: str, doc: str) -> DataFrame:
    return documents.select(column(doc).alias("doc"), F.xxhash64(column(text)).alias("t"), column(text).alias("text"))


def repeated_lines(documents: DataFrame, *, text: str = "text", doc: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, removed, runs): for each document with such lines, the places (from 0, sorted) of those in later copies of repeated runs,
    and the maximal runs, each with its start, n_lines, and doc_id and start of its first copy.

    Copies are in the order of doc_id (null first), then of the texts' hash, then of place; copies may lie in one document and overlap,
    and a line is removed if any later copy has it. Rows equal in doc_id and text are one document. Null and empty texts have
    no lines to remove; a very long text's lines are rows like all others; no documents, no rows; other columns are not read.
    """
    store = scratch(documents.sparkSession)
    docs = _texts(documents, text, doc).where("text is not null")
    lines = store(_lines(docs, min_chars))
    ids = _numbers(lines, ["h", "g"], "r0", store)
    active = store(lines.join(_many(ids), ["h", "g"]).select("doc", "t", "pos", "w", "r0").distinct())
    store.drop(1)
    spans = store(_stretches(active, min_chars))
    longest = spans.agg(F.max("m")).first()[0] or 0
    top, order = 0, Window.partitionBy("doc", "t").orderBy("pos")
    ranks = active.drop("w")
    while 2 ** (top + 1) <= longest:
        step = 2**top
        follows = F.lead("pos", step).over(order) == F.col("pos") + step
        pairs = ranks.withColumn("next", F.when(follows & F.col(f"r{top}").isNotNull(), F.lead(f"r{top}", step).over(order)))
        own, top = f"r{top}", top + 1
        pairs = store(pairs)
        ranks = store(pairs.join(_many(_numbers(pairs.where("next is not null"), [own, "next"], f"r{top}", store)), [own, "next"], "left").drop("next"))
    m = F.col("m")
    size = F.lit(1)
    for k in range(1, top + 1):
        size = F.when(m >= 2**k, 2**k).otherwise(size)
    renamed = lambda p: ranks.select("doc", "t", F.col("pos").alias("start" if p == "a" else "other"), *(F.col(f"r{k}").alias(f"{p}{k}") for k in range(top + 1)))
    named = _null_safe(spans, renamed("a"), "start").withColumn("other", F.col("start") + m - size)
    named = _null_safe(named.select("doc", "t", "start", "m", "other", _rank(m, top, "a").alias("x")).where("x is not null"), renamed("b"), "other").select("doc", "t", "start", "m", "x", _rank(m, top, "b").alias("y"))
    named = store(named.where("y is not null"))
    place = F.struct("doc", "t", "start")
    first = named.groupBy("m", "x", "y").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").drop("last")
    first = store(first)  # then both sides of the join are plain shuffles, and a line of very many copies can be split
    later = named.join(_many(first), ["m", "x", "y"]).where(place != F.col("first")).select("doc", "t", "start", F.expr("start + m - 1").alias("end"), F.col("first.doc").alias("fd"), F.col("first.t").alias("ft"), F.expr("start - first.start").alias("shift"))
    # stretches of one shift from one text that overlap or adjoin are one run; all is within a document, by which the rows are dealt once
    along = Window.partitionBy("doc", "t", "fd", "ft", "shift").orderBy("start", "end")
    before = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    later = later.repartition("doc", "t").withColumn("new", F.when(before >= F.col("start") - 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = later.groupBy("doc", "t", "fd", "ft", "shift", "run").agg(F.min("start").alias("a"), F.max("end").alias("z"))
    each = F.struct(F.col("a").alias("start"), F.expr("z - a + 1").alias("n_lines"), F.col("fd").alias("first_doc"), F.expr("a - shift").alias("first_start"))
    out = runs.groupBy("doc", "t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("a", "z"))))).alias("removed"), F.array_sort(F.collect_list(each)).alias("runs"))
    return out.select(F.col("doc").alias("doc_id"), F.col("t").alias("text_hash"), "removed", "runs")


def _joined(rows: DataFrame, documents: DataFrame, text: str, doc: str, min_chars: int) -> DataFrame:
    """rows (with doc and t of documents), removed and runs."""
    found = repeated_lines(documents, text=text, doc=doc, min_chars=min_chars).withColumnsRenamed({"doc_id": "_doc", "text_hash": "_t"})
    out = rows.join(found, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("t") == F.col("_t")), "left")
    return out.withColumns({"removed": F.coalesce("removed", F.array().cast("array<int>")), "runs": F.coalesce("runs", F.array().cast(found.schema["runs"].dataType))})


def line_report(documents: DataFrame, *, text: str = "text", doc: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines (0 for null), removed and runs for each row of documents; the texts stay where they are.

    Repeated rows get equal results, each its own row; null and empty texts have nothing removed; no documents, no rows.
    """
    slim = _texts(documents, text, doc).select("doc", "t", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    return _joined(slim, documents, text, doc, min_chars).select(F.col("doc").alias("doc_id"), "n_lines", "removed", "runs")


def dedup_lines(documents: DataFrame, *, text: str = "text", doc: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """documents with the later copies of repeated runs of lines taken out of the texts; all rows and columns stay, whatever their names.

    A text that loses all its lines becomes empty; null stays null; repeated rows stay, with equal texts.
    """
    names = documents.columns
    rows = documents.select(F.struct(*(column(c).alias(f"k_{i}") for i, c in enumerate(names))).alias("d"), column(doc).alias("doc"), F.xxhash64(column(text)).alias("t"))
    rows = _joined(rows, documents, text, doc, min_chars).select("d", "removed")
    own, gone = F.col(f"d.k_{names.index(text)}"), F.col("removed")
    # a column of its own, so that looking up a line doesn't split the text again
    rows = rows.withColumn("lines", F.when(F.size(gone) > 0, F.split(own, "\n")))
    # places to keep, as an array difference: in linear time
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone), lambda i: F.element_at("lines", i + 1))
    new = F.when(F.size(gone) == 0, own).otherwise(F.array_join(kept, "\n"))
    return rows.select(*((new if c == text else F.col(f"d.k_{i}")).alias(c) for i, c in enumerate(names)))
