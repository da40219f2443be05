"""Cells that functions and explosions make are not broadcast because Spark thinks them few."""

from gammaweave.operators import knn
from gammaweave.operators.geometry import grid
from gammaweave.plans.scanner import MOST_BROADCAST, Scanner


def test_filters_of_large_images_broadcast_no_cells(spark):
    s, m = Scanner(n=1024, nk=2), knn.Matching()
    assert s.voxels > MOST_BROADCAST
    x = grid(spark, s).where("vox < 3000").selectExpr("vox", "i", "j", "k", "CAST(vox AS DOUBLE) AS val")
    near = spark.range(8).selectExpr("CAST(2 * id AS INT) AS vox", "1 AS rank", "CAST(2 * id AS INT) AS nbr", "0e0 AS d")
    for make in (knn.filter_forward, knn.filter_backward):
        plan = make(x, near, s, m, 1)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [b#" in plan or "SortMergeJoin [a#" in plan
