"""Rows of lines are not broadcast because their written tables are small."""

from gammaweave.llm import linededup


def _plans(spark, monkeypatch, docs):
    """Plans of all tables that are written on the way, and of the result."""
    plans, plain = [], linededup.scratch

    def watched(spark):
        store = plain(spark)

        class Store:
            drop = store.drop

            def __call__(self, df, *by):
                plans.append(df._jdf.queryExecution().executedPlan().toString())
                return store(df, *by)

        return Store()

    monkeypatch.setattr(linededup, "scratch", watched)
    out = linededup.repeated_lines(docs)
    n = out.count()
    return [*plans, out._jdf.queryExecution().executedPlan().toString()], n


def test_line_joins_broadcast_no_lines(spark, monkeypatch):
    lines = "concat_ws('\\n', transform(sequence(1, 40), i -> concat('line ', i, ' of the text')))"
    plans, n = _plans(spark, monkeypatch, spark.range(200).selectExpr("id AS doc_id", f"{lines} AS text"))
    assert n == 199  # the first copy stays
    assert sum("Join" in p for p in plans) >= 4
    assert not any("Broadcast" in p for p in plans)
