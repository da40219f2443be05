"""What a run costs the driver: files that it doesn't read aren't written, and it starts no Python workers to write those that it does."""

from pathlib import Path

import numpy as np

from gammaweave import run_queries as R
from gammaweave.queries import QUERIES
from gammaweave.sources import ranges, raw

from .conftest import DATA

RUN = {"scan.lm", "scan.add_fac", "scan.mul_fac", "guess.img", "sens.img"}


def test_runs_write_the_files_that_they_read(spark):
    R._WRITTEN.clear()
    rows = QUERIES["run_em_projections"](spark, str(DATA))
    folder = Path(R.scan(spark, str(DATA)))
    assert {p.name for p in folder.iterdir() if p.is_file()} == RUN
    counts = {(r["name"], r["phase"], r["subset"]): r["count"] for r in rows.groupBy("name", "phase", "subset").count().collect()}
    assert counts == {(name, *at): n for name in ("Px", "Px_r_s") for at, n in ((("warmup", 0), 1000), (("main", 0), 500), (("main", 1), 500))}
    assert QUERIES["volume_scan_short"](spark, str(DATA)).count() == 2048
    assert {p.name for p in folder.iterdir() if p.is_file()} == RUN | {"short.img"}


def test_files_are_committed_in_the_driver_s_own_process(spark, tmp_path, monkeypatch):
    seen, commit = [], ranges.Writer.commit
    monkeypatch.setattr(ranges.Writer, "commit", lambda self, messages: (seen.append(sum(m.bytes for m in messages)), commit(self, messages)))
    raw.write_raw(spark.range(600_000).selectExpr("id", "id % 7 AS val"), f"{tmp_path}/v", "id")
    assert seen == [2_400_000] and [p.name for p in tmp_path.iterdir()] == ["v"]
    assert np.array_equal(np.fromfile(tmp_path / "v", "<f4"), np.arange(600_000) % 7)
