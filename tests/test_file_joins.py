"""Rows of files are not broadcast because Spark thinks them few."""

import numpy as np

from gammaweave.operators.project import with_factors
from gammaweave.sources import raw


def test_factor_files_are_not_broadcast(spark, tmp_path):
    n = 70_000
    np.arange(5 * n, dtype="<i2").tofile(tmp_path / "s.lm")
    np.ones(n - 1, "<f4").tofile(tmp_path / "s.add_fac")
    np.full(n, 2, "<f4").tofile(tmp_path / "s.mul_fac")
    prefix = str(tmp_path / "s")
    rows = with_factors(raw.read_events(spark, prefix), *(raw.read_factor(spark, f"{prefix}.{c}", c) for c in ("add_fac", "mul_fac")))
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.selectExpr("count(*)", "sum(add_fac)", "sum(mul_fac)").first() == (n, n - 1.0, 2.0 * n)
