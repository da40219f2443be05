"""What a run costs the driver: no broadcasts for joins by voxel, crystal or ring, each image sent once, no Python worker for a format, and few jobs."""

from gammaweave import queries as Q
from gammaweave import run_queries as R
from gammaweave.operators import geometry, trace
from gammaweave.plans import recon
from gammaweave.plans.scanner import SMALL
from gammaweave.sources import raw

from .conftest import DATA


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_volumes_and_updates_have_no_joins(spark, tmp_path):
    raw.write_raw(spark.range(SMALL.voxels - 5).selectExpr("id", "1e0 + id % 3 AS val"), f"{tmp_path}/v", "id")
    x, events = raw.read_volume(spark, f"{tmp_path}/v", SMALL), Q.events(spark, str(DATA))
    assert {r["vox"]: r["val"] for r in x.collect()} == {v: (1.0 + v % 3) * (v < SMALL.voxels - 5) for v in range(SMALL.voxels)}
    assert "Join" not in plan(x) and "Join" not in plan(geometry.lines_of_response(events, SMALL))
    p = recon.Problem(events, SMALL, sens=x)
    assert "Join" not in plan(recon.em_step(p, recon.ones(p)))


def test_an_image_is_sent_once_for_projections_and_update(spark, monkeypatch):
    sent, real = [], trace.as_array
    monkeypatch.setattr(trace, "as_array", lambda image, s: (sent.append(1), real(image, s))[1])
    p = recon.Problem(Q.full_events(spark, str(DATA)), SMALL, subsets=2)
    n = []
    recon.em(p, recon.ones(p), 1, recon.Outputs(projection=lambda k, m, rows: n.append(rows.count())))
    assert len(sent) == 2 and n == [1000, 1000]


def test_files_are_written_without_registering_a_format(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark.dataSource), "register", None)
    raw.write_raw(spark.range(9), f"{tmp_path}/v", "id", "id")
    assert (tmp_path / "v").stat().st_size == 36


def _jobs(spark, name: str) -> int:
    R._WRITTEN.clear()
    R._DONE.clear()
    spark.sparkContext.setJobGroup(name, name)
    try:
        Q.QUERIES[name](spark, str(DATA)).collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_runs_take_few_jobs(spark):
    got = {name: _jobs(spark, name) for name in ("run_em_projections", "run_em_likelihood", "run_line_section")}
    assert all(0 < n <= most for n, most in zip(got.values(), (50, 50, 45), strict=True)), got
