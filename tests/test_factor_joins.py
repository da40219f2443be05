"""Factors are not broadcast because their tables take few bytes."""

from gammaweave import queries as Q


def test_factors_of_small_files_are_not_broadcast(spark, tmp_path):
    n = 300_000
    spark.range(n).selectExpr("id AS event_id", "id % 50 AS user_id", "1e0 AS value").write.option("compression", "zstd").parquet(f"{tmp_path}/events.parquet")
    rows = Q.full_events(spark, str(tmp_path))
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.where("add_fac > 0 and mul_fac >= 1").count() == sum(k % 3 != 0 and k % 5 > 0 for k in range(n))
