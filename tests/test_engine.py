import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gammaweave import queries as Q
from gammaweave.functions.formulas import POTENTIALS, phi, slope, slope_over_t
from gammaweave.operators import blocks, geometry, knn, penalty, project, rays, sparse, stencil, tiles, trace
from gammaweave.plans import config, log, recon, run, session, store
from gammaweave.plans.scanner import SMALL, Scanner
from gammaweave.sources import ranges, raw, sinks
from gammaweave.streaming import live
from tests.conftest import DATA

D = str(DATA)


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


@pytest.mark.parametrize("tracer", ["siddon", "bresenham", "tof", "tof_bresenham"])
def test_projection_and_back_projection_are_adjoint(spark, tracer):
    lines = Q.lines(spark, D).withColumn("w", F.expr("1e0 + event_id % 7"))
    x = Q.image(spark)
    y, z = by(project.forward(lines, x, SMALL, tracer), "event_id", "y"), by(project.back(lines, SMALL, "w", tracer), "vox", "val")
    w, v = by(lines, "event_id", "w"), by(x, "vox", "val")
    assert sum(y[e] * w[e] for e in w) == pytest.approx(sum(v[k] * z.get(k, 0) for k in v))


@pytest.mark.parametrize("edge", [3, 5, 16])
@pytest.mark.parametrize("tracer", ["siddon", "bresenham", "tof", "tof_bresenham"])
def test_arrays_and_tiles_agree(spark, monkeypatch, tracer, edge):
    lines, x = Q.lines(spark, D).withColumn("w", F.expr("event_id % 3")), Q.image(spark)
    run = lambda **options: (by(project.forward(lines, x, SMALL, tracer, **options), "event_id", "y"), by(project.back(lines, SMALL, "w", tracer, **options), "vox", "val"))
    one = run()
    monkeypatch.setattr(tiles, "RAYS", 40)  # many parts a tile, added on two levels
    monkeypatch.setattr(tiles, "FAN", 3)
    two = run(edge=edge)
    assert one[0] == pytest.approx(two[0]) and one[1] == pytest.approx(two[1])


def test_larger_images_go_in_tiles(spark, monkeypatch):
    lines, x = Q.lines(spark, D), Q.image(spark)
    one = by(project.forward(lines, x, SMALL), "event_id", "y")
    monkeypatch.setattr(trace, "MOST_ARRAY", 0)
    monkeypatch.setattr(trace, "as_array", None)
    monkeypatch.setattr(tiles, "EDGE", 6)
    assert by(project.forward(lines, x, SMALL), "event_id", "y") == pytest.approx(one)


def test_an_image_is_the_same_packed(spark):
    x, t = Q.image(spark).where("vox % 5 <> 2 AND k <> 3"), tiles.Tiles(SMALL, 3)
    assert by(tiles.unpack(tiles.pack(x, t), t), "vox", "val") == by(x, "vox", "val")
    assert tiles.pack(x.limit(0), t).count() == 0 and tiles.unpack(tiles.pack(x.limit(0), t), t).count() == 0


def test_stencils_in_any_tiles_agree(spark, monkeypatch):
    x, m = Q.image(spark).where("vox % 11 <> 4"), knn.Matching(1, 0, 1, 1, 3, 2)
    def run():
        rows = [penalty.surrogate(x, SMALL, "fair", 0.3, 2), penalty.surrogate(x, SMALL, "hl", 0.3, 1, True), penalty.patch_surrogate(x, SMALL, "hw", 0.3, 1), penalty.patch_surrogate(x, SMALL, "huber", 0.3, 0, True)]
        out = [{r["vox"]: (r["t1"], r["t2"]) for r in t.collect()} for t in rows]
        near = {(r["vox"], r["rank"]): (r["nbr"], r["d"]) for r in knn.nearest(x, SMALL, m, 5).collect()}
        return [*out, by(penalty.gradient(x, SMALL, "huber", 0.3, 1), "vox", "grad"), near, by(knn.kernel_weights(x, SMALL, m, 2.0).groupBy("vox").agg(F.sum("w").alias("w")), "vox", "w")]

    one = run()
    assert all(len(x) == SMALL.voxels for x in one[:4])
    for edge in (3, 7):
        monkeypatch.setattr(stencil, "EDGE", edge)
        for a, b in zip(one, run(), strict=True):
            assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


@pytest.mark.parametrize("tracer", ["siddon", "tof"])
def test_em_in_tiles(spark, monkeypatch, tracer):
    p = lambda **options: recon.Problem(Q.full_events(spark, D), SMALL, subsets=2, tracer=tracer, transaxial=Q.psf(spark)[0], **options)
    monkeypatch.setattr(tiles, "RAYS", 100)
    a, b = p(), p(edge=6)
    one = by(recon.em(a, recon.ones(a), 2), "vox", "val")
    assert by(recon.em(b, recon.ones(b), 2), "vox", "val") == pytest.approx(one)
    ll = [[r["ll"] for r in recon.likelihoods(x.log).orderBy("iter", "subset").collect()] for x in (a, b)]
    assert ll[0] == pytest.approx(ll[1])


def test_blur_is_adjoint(spark):
    x, y = Q.image(spark), Q.image(spark).withColumn("val", F.expr("1e0 + vox % 13"))
    t, a = Q.psf(spark)
    u, v = by(sparse.blur(x, SMALL, t, a), "vox", "val"), by(sparse.blur(y, SMALL, t, a, True), "vox", "val")
    xs, ys = by(x, "vox", "val"), by(y, "vox", "val")
    assert sum(u[k] * ys[k] for k in ys) == pytest.approx(sum(xs[k] * v[k] for k in xs))
    assert by(sparse.blur(x, SMALL, None, None), "vox", "val") == pytest.approx(xs)


@pytest.mark.parametrize("edge,piece", [(1 << 16, 1 << 18), (50, 40), (7, 3)])
def test_products_in_blocks(spark, monkeypatch, edge, piece):
    monkeypatch.setattr(blocks, "FAN", 3)
    # a third of all entries in one row, a third in one column, the same entry twice, rows and columns that meet nothing
    entries = [(5, c, c / 7) for c in range(150)] + [(r, 90, 1 - r / 9) for r in range(150)] + [(k * 37 % 150, k * 11 % 150, k / 3) for k in range(150)] + [(3, 4, 2.0), (3, 4, 2.0), (200, 7, 0.0), (201, 160, 1.0)]
    m = spark.createDataFrame([*entries, (None, 1, 1.0), (1, None, 1.0), (1, 1, None)], "row int, col int, val double").repartition(5)
    for x in (spark.range(0, 150, 2), spark.range(150), spark.range(0)):
        x = x.selectExpr("id", "CAST(id + 1 AS DOUBLE) / 3 AS val")
        for transposed in (False, True):
            want = by(sparse.product(m.dropna(), x, transposed), "id", "val")
            got = blocks.write(m, store.scratch(spark), edge, transposed, piece).product(x)
            assert by(got, "id", "val") == pytest.approx(want) and len(got.collect()) == len(want)
    assert blocks.write(m.limit(0), store.scratch(spark), edge).product(spark.range(5).selectExpr("id", "1e0 AS val")).isEmpty()


def test_no_group_of_pieces_is_large(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FAN", 4)
    m = spark.range(20_000).selectExpr("CAST(id div 200 AS INT) AS row", "CAST(id % 200 AS INT) AS col", "1e0 AS val")  # one dense block
    b = blocks.write(m, store.scratch(spark), 256, piece=100)
    entries = b.pieces.selectExpr("to", "of", "salt", "length(row) / 4 AS n")
    assert entries.count() == 200 and entries.agg(F.max("n")).first()[0] < 200
    assert entries.groupBy("of", "salt").count().agg(F.max("count")).first()[0] <= 16
    assert {*by(b.product(spark.range(200).selectExpr("id", "1e0 AS val")), "id", "val").values()} == {200.0}


def test_filters_are_adjoint(spark):
    m, x = knn.Matching(), Q.image(spark)
    y = x.withColumn("val", F.expr("1e0 + vox % 13"))
    near = knn.nearest(x, SMALL, m, 3)
    f, b = by(knn.filter_forward(x, near, SMALL, m, 3), "vox", "val"), by(knn.filter_backward(y, near, SMALL, m, 3), "vox", "val")
    xs, ys = by(x, "vox", "val"), by(y, "vox", "val")
    assert sum(f[k] * ys[k] for k in ys) == pytest.approx(sum(xs[k] * b[k] for k in xs))
    assert all(r["nbr"] == r["vox"] for r in near.where("rank = 1").collect())


def test_lengths_are_conserved(spark):
    lines = Q.lines(spark, D)
    hits = {r["event_id"]: (r["t1"] - r["t0"]) * math.sqrt(r["dx"] ** 2 + r["dy"] ** 2 + r["dz"] ** 2) for r in rays.fov_hits(lines, SMALL).collect()}
    assert by(rays.segments(lines, SMALL, "event_id").groupBy("event_id").agg(F.sum("len").alias("l")), "event_id", "l") == pytest.approx(hits)


def test_edge_rays(spark):
    rows = [(0, -50.0, 2.0, 2.0, 50.0, 2.0, 2.0), (1, -50.0, 31.0, 2.0, 50.0, 31.0, 2.0), (2, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0), (3, -50.0, 4.0, 2.0, 50.0, 4.0, 2.0)]
    lines = spark.createDataFrame(rows, "event_id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double").selectExpr("*", "x1 - x0 AS dx", "y1 - y0 AS dy", "z1 - z0 AS dz", "1e0 AS w")
    got = by(rays.segments(lines, SMALL, "event_id").groupBy("event_id").agg(F.sum("len").alias("l")), "event_id", "l")
    assert got == pytest.approx({0: 60.0, 3: 60.0})  # a parallel ray, one that misses, one of no length, one on a face
    assert by(project.forward(lines, Q.image(spark), SMALL), "event_id", "y")[1] == 0
    for edge in (1, 4, 5):
        assert by(project.forward(lines, Q.image(spark), SMALL, edge=edge), "event_id", "y") == pytest.approx(by(project.forward(lines, Q.image(spark), SMALL), "event_id", "y"))
    assert project.back(lines.withColumn("w", F.lit(0.0)), SMALL).isEmpty()


def test_subsets_add_up(spark):
    lines = Q.lines(spark, D).withColumn("w", F.lit(1.0))
    parts = project.with_subset(lines, 3)
    total = by(project.back(lines, SMALL), "vox", "val")
    out = {}
    for m in range(3):
        for k, v in by(project.back(parts.where(F.col("subset_id") == m), SMALL), "vox", "val").items():
            out[k] = out.get(k, 0) + v
    assert out == pytest.approx(total)


def test_em_raises_the_likelihood_and_keeps_counts(spark):
    p = recon.Problem(Q.events(spark, D), SMALL)
    x = recon.em(p, recon.ones(p), 3)
    ll = [r["ll"] for r in recon.likelihoods(p.log).orderBy("iter").collect()]
    assert ll == sorted(ll) and len(ll) == 3
    s, v = by(p.s, "vox", "val"), by(x, "vox", "val")
    assert sum(v[k] * s[k] for k in s) == pytest.approx(p.project(x).where("y > 0").count())


def test_mixed_up_inputs(spark):
    events = Q.events(spark, D)
    assert geometry.unknown_ids(events, SMALL) == 0
    assert geometry.unknown_ids(events.withColumn("xtal_id_1", F.lit(48)), SMALL) == events.count()
    with pytest.raises(Exception, match="lacks"):
        geometry.lines_of_response(events.withColumn("ring_id_2", F.lit(8)), SMALL).agg(F.sum("z1")).collect()
    for bad in ({"rings": 0}, {"voxel": -1.0}, {"ring_diameter": 0}):
        with pytest.raises(ValueError):
            Scanner(**bad)
    with pytest.raises(ValueError):
        recon.kem(recon.Problem(events, SMALL), Q.kernel(spark).limit(0), geometry.grid(spark, SMALL), 1)
    with pytest.raises(ValueError):
        geometry.crystal_pairs(spark, Scanner(modules=11), 9)
    for s in (Scanner(half_step=True), Scanner(crystals=5)):
        pairs = geometry.crystal_pairs(spark, s, 11)
        assert pairs.count() == s.per_ring // 2 * 11
        assert pairs.where(f"xtal_1 NOT BETWEEN 0 AND {s.per_ring - 1} OR xtal_2 NOT BETWEEN 0 AND {s.per_ring - 1} OR xtal_1 = xtal_2").isEmpty()
    assert geometry.crystal_pairs(spark, SMALL, 11, True).count() == 7 * 6


@pytest.mark.parametrize("kind", POTENTIALS)
def test_slopes_are_derivatives(spark, kind):
    t = spark.createDataFrame([(x,) for x in (0.05, 0.2, 0.7, 1.9)], "t double")
    e = 1e-6
    for r in t.selectExpr("t", f"({phi(kind, f'(t + {e})', 0.3)}) - ({phi(kind, f'(t - {e})', 0.3)}) AS d", f"{slope(kind, 't', 0.3)} AS s", f"{slope_over_t(kind, 't', 0.3)} AS w").collect():
        # hw has a factor of its own (2 / delta squared), and fair a signed first term
        scale = {"fair": None, "hw": 2 / 0.09}.get(kind, 1.0)
        if scale:
            assert r["d"] / (2 * e) == pytest.approx(r["s"] * scale, rel=1e-4)
        assert r["s"] == pytest.approx(r["w"] * r["t"]) and r["w"] > 0


def test_surrogate_weights_are_positive(spark):
    for f in (lambda: penalty.surrogate(Q.image(spark), SMALL, "hl", 0.3, 1, True), lambda: penalty.patch_surrogate(Q.image(spark), SMALL, "fair", 0.3)):
        assert f().where("t1 <= 0").isEmpty()
    assert len(penalty.offset_list(2)) == 124 and penalty.offsets(spark, 0).count() == 6


GOOD = "image_size = 16, 16, 8\nvoxel_size=4,4,4 # mm\ndetector_ring_diameter = 120\ncrystal_size = 7.9,7.9,4,10\ncrystal_array_size = 4, 8\nnumber_of_detector_modules = 12, 1\n"


def test_settings():
    s = config.parse(GOOD + "iteration_setting = 2, 1, 3\nkernel_matrix = k.mat\nwhat = 1\n# end\n")
    assert s.scanner.per_ring == 48 and s.scanner.rings == 8 and s.subsets == 2 and s.warmup_subsets == 1 and s.unknown == ["what"] and s.get("kernel_matrix") == ["k.mat"]
    for bad in (GOOD + "image_size = 1,1,1\n", GOOD.replace("120", "-1"), GOOD.replace("16, 16, 8", "16, 16"), GOOD.replace("voxel_size=4,4,4", "# "), GOOD + "a = b = c\n", GOOD + "regularizer_potential_function_type = 6\n", GOOD + "iteration_setting = 0,1,1\n"):
        with pytest.raises(config.SettingsError):
            config.parse(bad)
    with pytest.raises(config.SettingsError):
        config.parse(GOOD + "iterative_algorithm_type = 7\n").algorithm  # noqa: B018
    assert config.split_list("1,2,") == ["1", "2"] and config.parse(GOOD + "regularizer_buildin_parameter_list = 1,-2\n").get("regularizer_buildin_parameter_list") == [1.0, 0.0]


def test_raw_files(spark, tmp_path):
    e = np.zeros(1001, raw.EVENT)
    e["xtal_id_1"], e["tbin_id"] = np.arange(1001) % 48, -2
    (tmp_path / "a.lm").write_bytes(e.tobytes() + b"xyz")
    got = raw.read_events(spark, f"{tmp_path}/a")
    assert got.count() == 1001 and got.where("event_id % 48 != xtal_id_1 OR tbin_id != -2").isEmpty()
    np.arange(5, dtype="<f4").tofile(tmp_path / "a.add_fac")
    assert by(raw.read_factor(spark, f"{tmp_path}/a.add_fac", "add_fac"), "event_id", "add_fac") == {k: float(k) for k in range(5)}
    assert raw.read_factor(spark, f"{tmp_path}/none", "x") is None and raw.file_length(spark, f"{tmp_path}/none") == 0 and raw.file_length(spark, f"{tmp_path}/a.add_fac") == 20
    v = by(raw.read_volume(spark, f"{tmp_path}/a.add_fac", SMALL), "vox", "val")
    assert len(v) == SMALL.voxels and v[4] == 4 and v[5] == 0
    assert {*by(raw.read_volume(spark, f"{tmp_path}/none", SMALL, 1.0), "vox", "val").values()} == {1.0}
    raw.write_raw(Q.image(spark), f"{tmp_path}/x.img", "vox")
    assert by(raw.read_volume(spark, f"{tmp_path}/x.img", SMALL), "vox", "val") == pytest.approx(by(Q.image(spark), "vox", "val"))
    m = spark.createDataFrame([(0, 3, 1.5), (2, 1, 0.25), (2, 5, 2.0)], "row int, col int, val double")
    raw.write_sparse(m, f"{tmp_path}/m", 4, 6)
    assert sorted(map(tuple, raw.read_sparse(spark, f"{tmp_path}/m").collect())) == [(0, 3, 1.5), (2, 1, 0.25), (2, 5, 2.0)]
    q = sparse.quantise(m, SMALL)
    raw.write_quantised(q, f"{tmp_path}/q", 4, 6)
    back, scale = raw.read_quantised(spark, f"{tmp_path}/q")
    assert sorted((r["row"], r["i"]) for r in back.collect()) == [(0, 3), (2, 1), (2, 5)]
    assert all(abs(r["w"] * scale - v) <= scale * 1.001 for r, v in zip(back.orderBy("row", "i").collect(), [1.5, 0.25, 2.0], strict=True))
    empty = tmp_path / "e.lm"
    empty.write_bytes(b"")
    with pytest.raises(ValueError):
        raw.read_events(spark, f"{tmp_path}/e")


def test_packed_entries_by_hand(spark, tmp_path):
    # i 5, j 1027, k 300, w 70000, lowest bits first: 11, 11, 9 and 17 bits in six bytes
    bits = 5 | 1027 << 11 | 300 << 22 | 70000 << 31
    entry = bits.to_bytes(6, "little")
    assert raw.pack([5], [1027], [300], [70000]).tobytes() == entry
    long_ = (5 | 1027 << 11 | 70000 << 22 | 300 << 39).to_bytes(6, "little")
    assert raw.pack([5], [1027], [70000], [300], True).tobytes() == long_
    for name, e in (("q", entry), ("l", long_)):
        (tmp_path / name).write_bytes(np.array([3, 9, 2], "<i4").tobytes() + np.array([0.5], "<f4").tobytes() + np.array([0, 1, 1, 2], "<i4").tobytes() + e + e)
    got, scale = raw.read_quantised(spark, f"{tmp_path}/q")
    assert scale == 0.5 and sorted(map(tuple, got.collect())) == [(0, 5, 1027, 300, 70000), (2, 5, 1027, 300, 70000)]
    assert sorted(map(tuple, raw.read_quantised(spark, f"file://{tmp_path}/l", True)[0].collect())) == [(0, 5, 1027, 70000, 300), (2, 5, 1027, 70000, 300)]
    with pytest.raises(ValueError):
        (tmp_path / "q").write_bytes((tmp_path / "q").read_bytes()[:-1])
        raw.read_quantised(spark, f"{tmp_path}/q")


def test_files_in_many_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(raw, "RANGE", 7)
    monkeypatch.setattr(raw, "BATCH", 3)
    m = spark.range(60).selectExpr("CAST(id % 23 AS INT) AS row", "CAST(id AS INT) AS col", "CAST(id + 0.5 AS DOUBLE) AS val").where("row not in (4, 5, 22)")
    raw.write_sparse(m, f"{tmp_path}/m", 23, 60)
    assert sorted(map(tuple, raw.read_sparse(spark, f"{tmp_path}/m").collect())) == sorted(map(tuple, m.collect()))
    q = sparse.quantise(m, SMALL)
    raw.write_quantised(q, f"{tmp_path}/q", 23, 60)
    assert sorted(map(tuple, raw.read_quantised(spark, f"{tmp_path}/q")[0].collect())) == sorted(map(tuple, q.drop("scale").collect()))
    raw.write_raw(spark.range(100).selectExpr("id", "id * 2 AS val"), f"{tmp_path}/v", "id")
    assert by(raw.records(spark, f"{tmp_path}/v", np.dtype("<f4"), "id"), "id", "val") == {k: 2.0 * k for k in range(100)}
    raw.write_sparse(m.limit(0), f"{tmp_path}/none", 5, 5)
    assert raw.read_sparse(spark, f"{tmp_path}/none").count() == 0


def test_written_files_by_hand(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(raw, "BATCH", 5)
    # half of all entries lie in one row, and rows 0, 3 and 22 have none
    rows = sorted({(7, c) for c in range(200)} | {(1 + c % 21, c) for c in range(200)} - {(3, c) for c in range(200)})
    m = spark.createDataFrame([(r, c, r + c / 4) for r, c in rows], "row int, col int, val double").repartition(7)
    raw.write_sparse(m, f"{tmp_path}/m", 23, 200)
    n = [sum(r == k for r, _ in rows) for k in range(23)]
    want = np.array([23, 200], "<i4").tobytes() + np.array([len(rows)], "<i8").tobytes() + np.array(n, "<i4").tobytes()
    want += np.array([c + 1 for _, c in rows], "<i4").tobytes() + np.array([r + c / 4 for r, c in rows], "<f4").tobytes()
    assert (tmp_path / "m").read_bytes() == want
    q = sparse.quantise(m, SMALL)
    raw.write_quantised(q, f"{tmp_path}/q", 23, 200)
    got = (tmp_path / "q").read_bytes()
    assert got[:12] == np.array([23, 200, len(rows)], "<i4").tobytes() and got[16 : 16 + 4 * 24] == np.append(0, np.cumsum(n)).astype("<i4").tobytes()
    assert len(got) == 16 + 4 * 24 + 6 * len(rows)
    events = spark.range(3, 40).selectExpr("id AS event_id", "id AS xtal_id_1", "id % 5 AS ring_id_1", "id + 1 AS xtal_id_2", "id % 7 AS ring_id_2", "-id AS tbin_id").repartition(4)
    raw.write_events(events, f"{tmp_path}/a")
    e = np.fromfile(tmp_path / "a.lm", raw.EVENT)
    k = np.arange(40) * (np.arange(40) >= 3)  # the first three places have no event
    assert np.array_equal(e["xtal_id_1"], k) and np.array_equal(e["tbin_id"], -k) and np.array_equal(e["ring_id_2"], k % 7)
    assert {p.name for p in tmp_path.iterdir()} == {"m", "q", "a.lm"}


def test_a_failed_write_leaves_the_old_file(spark, tmp_path):
    raw.write_raw(spark.range(4).selectExpr("id", "1 AS val"), f"{tmp_path}/v", "id")
    old = (tmp_path / "v").read_bytes()
    with pytest.raises(Exception, match="a bad one"):
        raw.write_raw(spark.range(900).selectExpr("id", "CASE WHEN id = 700 THEN raise_error('a bad one') ELSE 2 END AS val"), f"{tmp_path}/v", "id")
    assert (tmp_path / "v").read_bytes() == old and len([*tmp_path.iterdir()]) == 1
    with pytest.raises(Exception, match="append"):
        spark.createDataFrame([(0, b"x")], ranges.ROWS).write.format("byte_ranges").mode("append").save(f"{tmp_path}/v")
    raw.write_raw(spark.range(0), f"{tmp_path}/none", "id", "id")
    assert (tmp_path / "none").read_bytes() == b""


def test_a_store_without_places_gets_blocks_in_order(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(6, b"cd"), (0, b"ab"), (8, b"e")], ranges.ROWS).repartition(3)
    monkeypatch.setattr(ranges, "local", lambda path: None)
    ranges.write(rows, f"{tmp_path}/s", 12)
    assert (tmp_path / "s").read_bytes() == b"ab\0\0\0\0cde\0\0\0"
    monkeypatch.undo()
    ranges.write(rows, f"file://{tmp_path}/t", 12)
    assert (tmp_path / "t").read_bytes() == (tmp_path / "s").read_bytes()
    assert ranges.local("viewfs://a/b") is None and ranges.local("file:///a/b") == ranges.local("/a/b") == "/a/b"


def test_log_and_session(spark, tmp_path):
    with log.log_file(str(tmp_path / "scanner.log"), screen=False), log.timed("a step"):
        pass
    text = (tmp_path / "scanner.log").read_text()
    assert "log opened" in text and "a step ..." in text and " ms" in text and "log closed" in text
    assert session.session().sparkContext.applicationId == spark.sparkContext.applicationId
    with pytest.raises(ValueError):
        session.session(0)


def test_a_cluster_must_name_a_shared_folder():
    class Context:
        master = "local-cluster[2,1,1024]"

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        store.shared_folder(Session())
    Context.master = "local[2]"
    assert store.shared_folder(Session()).startswith("file://")


def test_sinks_and_stream(spark, tmp_path):
    sinks.write_projection(Q.QUERIES["siddon_forward"](spark, D), str(tmp_path), 1, 0)
    sinks.write_image(Q.image(spark), str(tmp_path), "x", 2)
    assert spark.read.parquet(f"{tmp_path}/projection").where("phase = 'main' AND iter = 1 AND subset = 0").count() == 1000
    events = Q.events(spark, D).selectExpr("event_id", *(f"CAST({c} AS SMALLINT) AS {c}" for c in ("xtal_id_1", "ring_id_1", "xtal_id_2", "ring_id_2", "tbin_id")), "1e0 AS w")
    events.repartition(3).write.parquet(f"{tmp_path}/events")
    assert live.latest(spark, f"{tmp_path}/live") is None
    q = live.start(live.event_stream(spark, f"{tmp_path}/events"), SMALL, f"{tmp_path}/live", f"{tmp_path}/state")
    q.processAllAvailable()
    for k in range(3):  # more files, a batch each
        events.where(f"event_id % 3 = {k}").write.mode("append").parquet(f"{tmp_path}/events")
        q.processAllAvailable()
    got = by(live.latest(spark, f"{tmp_path}/live"), "vox", "val")
    assert len(live.versions(spark, f"{tmp_path}/live")) == live.KEPT
    q.stop()
    want = by(project.back(geometry.lines_of_response(events, SMALL), SMALL), "vox", "val")
    assert got == pytest.approx({k: 2 * v for k, v in want.items()})


def test_admm_and_saved_images(spark):
    p = recon.Problem(Q.full_events(spark, D), SMALL, beta=0.1, penalty=recon.patch(SMALL))
    saved = []
    x = recon.em(p, recon.ones(p), 2, recon.Outputs(2, lambda n, v: saved.append(n)))
    assert saved == [2] and x.where("val < 0 OR isnan(val)").isEmpty()
    seen = []
    out = recon.Outputs(1, lambda n, v: seen.append(("image", n)), lambda n, v: seen.append(("alpha", n, v.count())))
    recon.kem(recon.Problem(Q.full_events(spark, D), SMALL), Q.kernel(spark), recon.ones(p), 1, out)
    recon.admm(recon.Problem(Q.full_events(spark, D), SMALL), recon.ones(p), 1, recon.mrf(SMALL), 0.1, 1, out)
    assert seen == [("image", 1), ("alpha", 1, SMALL.voxels), ("image", 1)]


def test_whole_runs(spark, tmp_path):
    e = np.zeros(200, raw.EVENT)
    for r, (k, x) in zip(e, enumerate(Q.events(spark, D).orderBy("event_id").limit(200).collect()), strict=True):
        r["xtal_id_1"], r["ring_id_1"], r["xtal_id_2"], r["ring_id_2"], r["tbin_id"] = x["xtal_id_1"], x["ring_id_1"], x["xtal_id_2"], x["ring_id_2"], x["tbin_id"]
    for name in ("scan.lm", "scan"):
        (tmp_path / name).write_bytes(e.tobytes())
    text = GOOD + f"input_raw_data_file = {tmp_path}/scan\ninput_raw_data_format_type = 0\niteration_setting = 2,1,1\nwarmup_setting = 1,1\nregularizer_model_type = 0\n"
    for kind in (0, 1):
        x, rows = run.reconstruct(spark, config.parse(text + f"iterative_algorithm_type = {kind}\nregularizer_strength = 0.1\n"), f"{tmp_path}/out{kind}")
        assert x.count() == SMALL.voxels and x.where("isnan(val) OR val < 0").isEmpty()
        phase = "main" if kind == 0 else "admm 1"
        assert {(r["phase"], r["iter"], r["subset"]) for r in rows.collect()} == {("warmup", 1, 0), (phase, 1, 0), (phase, 1, 1)}
    assert spark.read.parquet(f"{tmp_path}/out0/intermediate/iter=1").count() == SMALL.voxels
    y = run.lines(spark, config.parse(text), True, folder=f"{tmp_path}/out")
    assert y.count() == 200 and y.where("factor > 1 OR factor < 0").isEmpty()
    with pytest.raises(config.SettingsError):
        run.reconstruct(spark, config.parse(text.replace("format_type = 0", "format_type = 1")))
    with pytest.raises(config.SettingsError):
        run.line_section(spark, config.parse(text + "iterative_algorithm_type = 2\n"), str(tmp_path))
