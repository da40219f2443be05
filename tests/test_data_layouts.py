"""Sinograms, subsets and stored system matrices."""

import pytest
from pyspark.sql import functions as F

from gammaweave import queries as Q
from gammaweave.operators import geometry, project, sinogram, stored, subsets
from gammaweave.plans.scanner import SMALL
from gammaweave.plans.store import scratch
from tests.conftest import DATA

D = str(DATA)


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_bins_hold_the_events_that_have_a_pair(spark):
    events, pairs = Q.events(spark, D), geometry.crystal_pairs(spark, SMALL, 20)
    counts = sinogram.histogram(events, pairs, SMALL)
    inside = events.count() - sinogram.outside(events, pairs, SMALL)
    assert 0 < inside == counts.agg(F.sum("n")).first()[0]
    turned = events.selectExpr("event_id", "xtal_id_2 AS xtal_id_1", "ring_id_2 AS ring_id_1", "xtal_id_1 AS xtal_id_2", "ring_id_1 AS ring_id_2", "tbin_id")
    assert sorted(map(tuple, sinogram.histogram(turned, pairs, SMALL).collect())) == sorted(map(tuple, counts.collect()))
    rows = sinogram.as_events(counts, pairs, SMALL)
    assert rows.select("event_id").distinct().count() == rows.count() == counts.count()
    kept = sinogram.placed(events, pairs, SMALL).select("event_id")
    one = by(project.back(geometry.lines_of_response(events.join(kept, "event_id"), SMALL).withColumn("w", F.lit(1.0)), SMALL), "vox", "val")
    assert by(project.back(geometry.lines_of_response(rows, SMALL), SMALL, "mul_fac"), "vox", "val") == pytest.approx(one)
    assert sinogram.histogram(events.limit(0), pairs, SMALL).isEmpty()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_places_are_a_permutation(spark, n):
    for seed in (1, 2**31):
        got = [r["p"] for r in spark.range(n).selectExpr(f"{subsets.permutation('id', n, seed)} AS p").collect()]
        assert sorted(got) == list(range(n))
        assert n < 60 or sum(abs(a - b) == 1 for a, b in zip(got, got[1:], strict=False)) < n / 10


def test_subsets_by_angle_have_equal_counts_and_all_directions(spark):
    rows = subsets.by_angle(Q.lines(spark, D), 3, 12).withColumn("angle", F.expr("pmod(atan2(dy, dx), pi())"))
    per = {r["angle_range"]: r for r in rows.groupBy("angle_range").agg(F.count("*").alias("n"), F.min("angle").alias("a"), F.max("angle").alias("z"), F.max("subset_id").alias("s")).collect()}
    assert sum(r["n"] for r in per.values()) == Q.events(spark, D).count() and all(r["s"] == k % 3 for k, r in per.items())
    assert max(r["n"] for r in per.values()) < 2 * sum(r["n"] for r in per.values()) / 12


def test_a_stored_matrix_is_not_shuffled(spark):
    lines = Q.lines(spark, D).withColumn("w", F.expr("event_id % 3"))
    m = stored.write(project.system_matrix(lines, SMALL), scratch(spark), 4)
    x = Q.image(spark, D)
    want = {k: v for k, v in by(project.forward(lines, x, SMALL), "event_id", "y").items() if v}
    assert by(m.forward(x), "event_id", "y") == pytest.approx(want)
    assert by(m.back(lines, "w", 2).where("val <> 0"), "vox", "val") == pytest.approx(by(project.back(lines, SMALL, "w", power=2), "vox", "val"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for plan, name in ((m.forward(x), "by_voxel"), (m.back(lines), "by_event")):
            text = plan._jdf.queryExecution().executedPlan().toString().split("\n")
            at = next(k for k, line in enumerate(text) if name in line)
            depth = len(text[at]) - len(text[at].lstrip(" :+-"))
            above = [line for line in text[:at] if "Exchange" in line and len(line) - len(line.lstrip(" :+-")) < depth]
            assert "Bucketed: true" in text[at] and len(above) == 1  # the sums' own
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    m.drop()


def test_buckets_of_a_stored_matrix_follow_the_events_and_its_rows_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(stored, "EVENTS", 50)
    events = Q.events(spark, D)
    m = stored.traced(events, SMALL, scratch(spark))
    assert spark.sql(f"DESCRIBE EXTENDED {m.by_event}").where("col_name = 'Num Buckets'").first()["data_type"] == str(-(-events.count() // 50))
    x, lines = Q.image(spark, D), Q.lines(spark, D).withColumn("w", F.expr("event_id % 3"))
    want = {k: v for k, v in by(project.forward(lines, x, SMALL), "event_id", "y").items() if v}
    assert by(m.forward(x), "event_id", "y") == pytest.approx(want)
    assert by(m.back(lines).where("val <> 0"), "vox", "val") == pytest.approx(by(project.back(lines, SMALL, "w"), "vox", "val"))
    text = m.forward(x)._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(k for k, line in enumerate(text) if "by_event" in line)
    depth = len(text[at]) - len(text[at].lstrip(" :+-"))
    assert "Bucketed: true" in text[at] and not [line for line in text[:at] if "Exchange" in line and len(line) - len(line.lstrip(" :+-")) < depth]
    m.drop()
