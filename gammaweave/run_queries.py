"""Registered queries of files, settings and whole runs, and their DuckDB oracles.

A scan is written for each session and folder of tables, in the shared folder: events, factors, volumes and matrices, each file once, when a query first reads it or runs by a settings
file that names it. What the files hold as floats, the oracles cast to floats.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as Q
from .operators import blocks, geometry, knn, project, sinogram, sparse, stored, subsets
from .plans import config, recon, run
from .plans.scanner import SMALL, Scanner
from .plans.store import scratch, shared_folder
from .queries import query
from .sources import raw, sinks

_WRITTEN: dict = {}
_SENS, _SHORT = "500e0 + 10 * (vox % 11)", 700
#: The scanner of all settings here, and what names the scan's files.
_BASE = "image_size = 16, 16, 8\nvoxel_size = 4, 4, 4\ndetector_ring_diameter = 120\ncrystal_size = 7.9, 7.9, 4, 10\ncrystal_array_size = 4, 8\nnumber_of_detector_modules = 12, 1\n"
_INPUT = "input_raw_data_file = {f}/scan\ninput_raw_data_format_type = 0\ninitial_guess = {f}/guess.img\nsensitivity = {f}/sens.img\nreconstruction_output_setting = {f}/out, image\n"


class Scan:
    """The scan of a folder of tables. Its files are written as they are asked for, each once, from tables that are written once: what a query doesn't read costs its driver no plans."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d, self.store, self.tables, self.written = spark, d, scratch(spark), {}, set()
        self.folder = re.sub("^file:/+", "/", shared_folder(spark)) + f"/scan-{uuid.uuid4().hex}"

    def table(self, make) -> DataFrame:
        if make not in self.tables:
            self.tables[make] = self.store(make(self.spark, self.d))
        return self.tables[make]

    def write(self, *names: str) -> None:
        for name in names:
            if name not in self.written:
                _WRITERS[name](self, f"{self.folder}/{name}")
                self.written.add(name)


def _matrix(s: Scan) -> DataFrame:
    return Q.matrix(s.spark, s.d)


#: How each file is written, by its name.
_WRITERS = {
    **{f"scan{suffix}": lambda s, path: raw.write_events(s.table(Q.full_events), path, "") for suffix in (".lm", "")},
    **{f"scan.{c}": lambda s, path, c=c: raw.write_raw(s.table(Q.full_events), path, "event_id", c) for c in ("add_fac", "mul_fac")},
    **{f"{name}.img": lambda s, path, v=value: raw.write_raw(s.table(Q.image).selectExpr("vox", f"{v} AS v"), path, "vox", "v") for name, value in (("guess", "val"), ("kappa", "kappa"), ("sens", _SENS))},
    "short.img": lambda s, path: raw.write_raw(s.table(Q.image).where(f"vox < {_SHORT}"), path, "vox"),
    "trans.mat": lambda s, path: raw.write_sparse(Q.psf(s.spark)[0], path, 256, 256),
    "axial.mat": lambda s, path: raw.write_sparse(Q.psf(s.spark)[1], path, 8, 8),
    "kernel.mat": lambda s, path: raw.write_sparse(Q.kernel(s.spark), path, SMALL.voxels, SMALL.voxels),
    "matrix.mat": lambda s, path: raw.write_sparse(_matrix(s), path, 40, 60),
    "matrix.quant": lambda s, path: raw.write_quantised(sparse.quantise(_matrix(s), SMALL), path, 40, 60),
    # without the wide axial indices, weights have nine bits
    "long.quant": lambda s, path: raw.write_quantised(sparse.quantise(_matrix(s), SMALL, 511), path, 40, 60, True),
}


def scan(spark: SparkSession, d: str, *names: str) -> str:
    """The folder of the scan's files, in which those named are."""
    key = spark.sparkContext.applicationId, d
    if key not in _WRITTEN:
        _WRITTEN.clear()
        _WRITTEN[key] = Scan(spark, d)
    _WRITTEN[key].write(*names)
    return _WRITTEN[key].folder


def _settings(spark: SparkSession, d: str, more: str, events: str = "scan.lm") -> config.Settings:
    """Settings of a run, with the files that they name; events: the file that the run reads."""
    text = _BASE + _INPUT + more
    named = [n for n in re.findall(r"\{f\}/([\w.]+)", text) if n in _WRITERS and n != "scan"]
    return config.parse(text.format(f=scan(spark, d, events, "scan.add_fac", "scan.mul_fac", *named)))


def _float(x: str) -> str:
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"


# --- files
query("event_scan", f"WITH {Q._EV} SELECT {Q._id('event_id', 'xtal_id_1', 'ring_id_1', 'xtal_id_2', 'ring_id_2', 'tbin_id')} FROM ev")(lambda spark, d: Q.out(raw.read_events(spark, f"{scan(spark, d, "scan.lm")}/scan")))
query("event_scan_bare", f"WITH {Q._EV} SELECT {Q._id('event_id', 'xtal_id_1', 'ring_id_1', 'xtal_id_2', 'ring_id_2', 'tbin_id')} FROM ev")(lambda spark, d: Q.out(raw.read_events(spark, f"{scan(spark, d, "scan")}/scan", "")))
for _name in ("add_fac", "mul_fac"):
    query(f"factor_scan_{_name}", f"WITH {Q._EV}, {Q._FAC} SELECT {Q._id('event_id')}, {Q._r(_float(_name), _name, 6)} FROM fac")(
        lambda spark, d, c=_name: Q.out(raw.read_factor(spark, f"{scan(spark, d, f"scan.{c}")}/scan.{c}", c).withColumn(c, F.col(c).cast("double")), digits=6))
query("factors_missing", f"WITH {Q._EV} SELECT {Q._id('event_id')}, 0e0 AS add_fac, 1e0 AS mul_fac FROM ev")(
    lambda spark, d: Q.out(project.with_factors(Q.events(spark, d), *(raw.read_factor(spark, f"{scan(spark, d)}/none.{c}", c) for c in ("add_fac", "mul_fac"))), "event_id", "add_fac", "mul_fac"))
_VOLUME = "SELECT CAST(vox AS BIGINT) AS vox, {} FROM img"
query("volume_scan", f"WITH {Q._IMG} {_VOLUME.format(Q._r(_float('val'), 'val', 6))}")(lambda spark, d: Q.out(raw.read_volume(spark, f"{scan(spark, d, "guess.img")}/guess.img", SMALL), digits=6))
query("volume_scan_short", f"WITH {Q._IMG} {_VOLUME.format(Q._r(f'CASE WHEN vox < {_SHORT} THEN {_float("val")} ELSE 0e0 END', 'val', 6))}")(lambda spark, d: Q.out(raw.read_volume(spark, f"{scan(spark, d, "short.img")}/short.img", SMALL), digits=6))
query("volume_missing", f"WITH {Q._IMG} {_VOLUME.format('1e0 AS val')}")(lambda spark, d: Q.out(raw.read_volume(spark, f"{scan(spark, d)}/none.img", SMALL, 1.0)))
query("file_lengths", f"WITH {Q._EV} SELECT * FROM (VALUES ('none', 0), ('sens.img', 8192), ('short.img', {4 * _SHORT})) t(name, bytes) UNION ALL SELECT 'scan.lm', 10 * count(*) FROM ev UNION ALL SELECT 'scan.add_fac', 4 * count(*) FROM ev")(
    lambda spark, d: spark.createDataFrame([(n, raw.file_length(spark, f"{scan(spark, d, "sens.img", "short.img", "scan.lm", "scan.add_fac")}/{n}")) for n in ("none", "sens.img", "short.img", "scan.lm", "scan.add_fac")], "name string, bytes long"))
query("csr_scan", f"WITH {Q._MX} SELECT {Q._id('row', 'col')}, {Q._r(_float('val'), 'val')} FROM mx")(lambda spark, d: Q.out(raw.read_sparse(spark, f"{scan(spark, d, "matrix.mat")}/matrix.mat").withColumn("val", F.col("val").cast("double"))))
for _name, _levels, _long in (("quantised_scan", 131071, False), ("quantised_scan_long", 511, True)):
    query(_name, f"WITH {Q._MX}, qu AS (SELECT row, col, floor(val / ((SELECT max(val) FROM mx) / {_levels})) AS w, (SELECT max(val) FROM mx) / {_levels} AS scale FROM mx) SELECT CAST(row AS BIGINT) AS row, CAST(col % 16 AS BIGINT) AS i, CAST(col // 16 % 16 AS BIGINT) AS j, CAST(col // 256 AS BIGINT) AS k, CAST(w AS BIGINT) AS w, {Q._r(_float('scale'), 'scale', 6)} FROM qu")(
        lambda spark, d, n="long" if _long else "matrix", long=_long: (lambda got: Q.out(got[0].withColumn("scale", F.lit(got[1])), digits=6))(raw.read_quantised(spark, f"{scan(spark, d, f"{n}.quant")}/{n}.quant", long)))


def _kernel_files(spark: SparkSession, d: str) -> DataFrame:
    f, x = scan(spark, d), Q.image(spark, d)
    sinks.write_kernel(knn.kernel_weights(x, SMALL, Q._M, 2.0), knn.nearest(x, SMALL, Q._M, Q._K), f)
    w, n = spark.read.parquet(f"{f}/ker_weight"), spark.read.parquet(f"{f}/ker_ind")
    return Q.out(n.join(w, ["vox", "nbr"]), "vox", "rank", "nbr", "w")


query("kernel_files", f"WITH {Q._IMG}, {Q._KN} SELECT CAST(v AS BIGINT) AS vox, rank, CAST(u AS BIGINT) AS nbr, {Q._r('exp(-d / 2e0)', 'w')} FROM kn")(_kernel_files)

# --- sinogram bins
_CP = "SELECT CAST(a AS BIGINT) AS angle, CAST(b AS BIGINT) AS bin, CAST((({f} - (b + {p}) // 2 + {n}) % {n} + a) % {n} AS BIGINT) AS xtal_1, CAST(({g} + (b + {p} + 1) // 2 + a) % {n} AS BIGINT) AS xtal_2 FROM range({h}) x(a), range(21) y(b)"


def _pairs_sql(keep: str = "", **numbers) -> str:
    """Bins with their crystals, and how many events fall to each."""
    cp = f"cp AS ({_CP.format(**numbers)}{keep})"
    hits = "hi AS (SELECT angle, bin, count(*) AS n FROM ev JOIN cp ON least(xtal_id_1, xtal_id_2) = least(xtal_1, xtal_2) AND greatest(xtal_id_1, xtal_id_2) = greatest(xtal_1, xtal_2) GROUP BY ALL)"
    return f"WITH {Q._EV}, {cp}, {hits} SELECT cp.*, coalesce(n, 0) AS n_events FROM cp LEFT JOIN hi USING (angle, bin)"


def _pairs(spark: SparkSession, d: str, s: Scanner, compressed: bool = False) -> DataFrame:
    pairs = geometry.crystal_pairs(spark, s, 20, compressed)
    counts = sinogram.placed(Q.events(spark, d), pairs, s).groupBy("angle", "bin").agg(F.count("*").alias("n_events"))
    return Q.out(pairs.join(counts, ["angle", "bin"], "left").fillna(0, "n_events"))


_SMALL_BINS = {"f": 13, "p": 13, "g": 14, "n": 48, "h": 24}
query("crystal_pairs", _pairs_sql(**_SMALL_BINS))(lambda spark, d: _pairs(spark, d, SMALL))
query("crystal_pairs_half_step", _pairs_sql(f=10, p=11, g=13, n=48, h=24))(lambda spark, d: _pairs(spark, d, replace(SMALL, half_step=True)))
query("crystal_pairs_odd", _pairs_sql(f=16, p=18, g=18, n=60, h=30))(lambda spark, d: _pairs(spark, d, replace(SMALL, crystals=5)))
query("crystal_pairs_compressed", _pairs_sql(" WHERE a < 7 AND b <= 10", **_SMALL_BINS))(lambda spark, d: _pairs(spark, d, SMALL, True))
_IN_BINS = (f"cp AS ({_CP.format(**_SMALL_BINS)}), sb AS (SELECT event_id, angle, bin, CASE WHEN xtal_id_1 = xtal_1 THEN ring_id_1 ELSE ring_id_2 END AS ring_1, CASE WHEN xtal_id_1 = xtal_1 THEN ring_id_2 ELSE ring_id_1 END AS ring_2 "
            "FROM ev JOIN cp ON xtal_id_1 = xtal_1 AND xtal_id_2 = xtal_2 OR xtal_id_1 = xtal_2 AND xtal_id_2 = xtal_1)")  # fmt: skip


def _bins(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pairs = geometry.crystal_pairs(spark, SMALL, 20)
    return sinogram.histogram(Q.events(spark, d), pairs, SMALL), pairs


query("sinogram_histogram", f"WITH {Q._EV}, {_IN_BINS} SELECT {Q._id('angle', 'bin', 'ring_1', 'ring_2')}, count(*) AS n FROM sb GROUP BY ALL")(lambda spark, d: Q.out(_bins(spark, d)[0]))
query("sinogram_forward", f"WITH {Q._LN}, {Q._IMG}, {Q._seg()}, {_IN_BINS}, fw AS (SELECT event_id, sum(val * len) AS y FROM seg JOIN img USING (vox) GROUP BY event_id) SELECT {Q._id('angle', 'bin', 'ring_1', 'ring_2')}, {Q._r('max(coalesce(y, 0e0))', 'y')} FROM sb LEFT JOIN fw USING (event_id) GROUP BY ALL")(
    lambda spark, d: _sinogram_forward(spark, d))
query("sinogram_back", f"WITH {Q._LN}, {Q._seg()}, {_IN_BINS} SELECT {Q._id('vox')}, {Q._r('sum(len)', 'val', 3)} FROM seg JOIN sb USING (event_id) GROUP BY vox")(
    lambda spark, d: Q.out(project.back(geometry.lines_of_response(sinogram.as_events(*_bins(spark, d), SMALL), SMALL), SMALL, "mul_fac"), digits=3))


def _sinogram_forward(spark: SparkSession, d: str) -> DataFrame:
    """Line integrals of the bins that have events."""
    counts, pairs = _bins(spark, d)
    y = project.forward(geometry.lines_of_response(sinogram.as_events(counts, pairs, SMALL), SMALL), Q.image(spark, d), SMALL)
    of = sinogram.as_events(counts.withColumn("n", F.lit(1)), pairs, SMALL).selectExpr("event_id", "xtal_id_1 AS xtal_1", "xtal_id_2 AS xtal_2", "ring_id_1 AS ring_1", "ring_id_2 AS ring_2")
    return Q.out(y.join(of, "event_id").join(pairs, ["xtal_1", "xtal_2"]), "angle", "bin", "ring_1", "ring_2", "y")


# --- other subsets
_AT = f"CAST(floor(((atan2(dy, dx) + pi()) - pi() * floor((atan2(dy, dx) + pi()) / pi())) * {subsets.STEPS} / pi() + 0.37e0) AS INT) % {subsets.STEPS}"
query("angle_subsets", f"WITH {Q._LN}, an AS (SELECT event_id, {_AT} AS st FROM ln), hs AS (SELECT st, count(*) AS n FROM an GROUP BY st), cu AS (SELECT st, sum(n) OVER (ORDER BY st) - n AS b, sum(n) OVER () AS t FROM hs) SELECT {Q._id('event_id')}, CAST(b * 12 // t AS BIGINT) AS angle_range, CAST(b * 12 // t % 3 AS BIGINT) AS subset_id FROM an JOIN cu USING (st)")(
    lambda spark, d: Q.out(subsets.by_angle(Q.lines(spark, d), 3, 12), "event_id", "angle_range", "subset_id"))


def _permuted_sql() -> str:
    """The same turns of a rectangle, step by step: 4 rounds, and 12 more passes for what falls outside."""
    mixed = lambda x, k: f"((({x} * 48271 + {k}) % 2147483647) * 16807 + {k % 7919} + (({x} + {k}) % 8191) * 7907) % 2147483647"
    parts = ["nn AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS h FROM events)", "p0 AS (SELECT event_id, event_id AS v, n, h, (n + h - 1) // h AS w, false AS done FROM events, nn)"]
    for k in range(13):
        at = f"SELECT event_id, v, n, h, w, done, v // w AS a, v % w AS b FROM p{k}"
        for r in range(4):
            x, y = ((1_000_003 + i * 7_919 + 12_345) % 2147483647 for i in (2 * r, 2 * r + 1))
            at = f"SELECT * REPLACE ((a + {mixed('b', x)}) % h AS a) FROM ({at})"
            at = f"SELECT * REPLACE ((b + {mixed('a', y)}) % w AS b) FROM ({at})"
        parts.append(f"p{k + 1} AS MATERIALIZED (SELECT event_id, CASE WHEN done THEN v ELSE a * w + b END AS v, n, h, w, done OR a * w + b < n AS done FROM ({at}))")
    return f"WITH {', '.join(parts)} SELECT CAST(event_id AS BIGINT) AS event_id, CAST(v AS BIGINT) AS place, CAST(v % 4 AS BIGINT) AS subset_id FROM p13"


query("permuted_subsets", _permuted_sql())(lambda spark, d: Q.out(subsets.permuted(Q.events(spark, d), 4), "event_id", "place", "subset_id"))

# --- the same in tiles, which cut the small image into several
for _name, _options, _of in (("siddon_forward", (), "tiled_forward"), ("tof_forward", ("tof",), "tiled_tof_forward")):
    query(_of, Q.ORACLES[_name])(lambda spark, d, o=_options: Q.out(project.forward(Q.lines(spark, d), Q.image(spark, d), SMALL, *o, edge=6)))
for _name, _options, _of in (("siddon_back", ("siddon",), "tiled_back"), ("bresenham_back", ("bresenham",), "tiled_bresenham_back"), ("siddon_back_square", ("siddon", 2), "tiled_back_square")):
    query(_of, Q.ORACLES[_name])(lambda spark, d, o=_options: Q.out(project.back(Q.lines(spark, d).withColumn("w", F.expr(Q._W)), SMALL, "w", *o, edge=6), digits=3))
query("tiled_osem_2x2", Q.ORACLES["osem_2x2"])(lambda spark, d: (lambda p: Q.out(recon.em(p, recon.ones(p), 2)))(Q.problem(spark, d, subsets=2, edge=6)))


def _stored(spark: SparkSession, d: str) -> stored.StoredMatrix:
    return stored.traced(Q.events(spark, d), SMALL, scratch(spark))


query("stored_forward", Q.ORACLES["siddon_forward"])(lambda spark, d: Q.out(project.merged(Q.events(spark, d), _stored(spark, d).forward(Q.image(spark, d)))))
query("stored_back", Q.ORACLES["siddon_back"])(lambda spark, d: Q.out(_stored(spark, d).back(Q.events(spark, d).withColumn("w", F.expr(Q._W))), digits=3))
query("stored_em", Q.ORACLES["em_update"])(lambda spark, d: Q.out(stored.em(_stored(spark, d), Q.full_events(spark, d), geometry.grid(spark, SMALL).selectExpr("vox", "1e0 AS val"), 1)))

# --- sparse products in blocks, which cut the small matrix into many
_BY_COL = Q.ORACLES["csr_quantised_forward"].replace("CAST(row AS BIGINT) AS id", "CAST(col AS BIGINT) AS id").replace("range(60)", "range(40)").replace("ON col = id GROUP BY row", "ON row = id GROUP BY col")
query("csr_quantised_back", _BY_COL)(lambda spark, d: Q.out(sparse.quantised_product(sparse.quantise(Q.matrix(spark, d), SMALL), Q._x(spark, 40), SMALL, True)))
for _name, _n, _transposed in (("csr_forward", 60, False), ("csr_back", 40, True)):
    query(_name.replace("csr", "blocked"), Q.ORACLES[_name])(lambda spark, d, n=_n, t=_transposed: Q.out(blocks.write(Q.matrix(spark, d), scratch(spark), 7, t, 20).product(Q._x(spark, n))))
query("blocked_quantised_back", _BY_COL)(
    lambda spark, d: Q.out(blocks.write(sparse.unquantised(sparse.quantise(Q.matrix(spark, d), SMALL), SMALL), scratch(spark), 16, True, 20).product(Q._x(spark, 40))))

# --- guards
query("back_zero_weights", f"WITH {Q._LN}, {Q._seg()} SELECT {Q._id('vox')}, {Q._r('sum(len * (event_id % 4))', 'val', 3)} FROM seg WHERE event_id % 4 > 0 GROUP BY vox")(
    lambda spark, d: Q.out(project.back(Q.lines(spark, d).withColumn("w", F.expr("CASE event_id % 4 WHEN 0 THEN 1e-40 ELSE event_id % 4 END")), SMALL), digits=3))
_TERM = "CASE event_id % 7 WHEN 0 THEN value WHEN 1 THEN 0e0 WHEN 2 THEN -3e0 WHEN 3 THEN CAST('nan' AS DOUBLE) WHEN 4 THEN CAST('inf' AS DOUBLE) WHEN 5 THEN CAST('-inf' AS DOUBLE) ELSE 1e-30 END"
query("log_terms", f"SELECT {Q._r('sum(CASE WHEN isnan(x) OR isinf(x) OR x = 0 THEN ln(1e-20) WHEN x > 0 THEN ln(x + 1e-20) ELSE 0e0 END)', 'l2', 3)} FROM (SELECT {_TERM} AS x FROM events)")(
    lambda spark, d: Q.out(recon.log_sum(spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", f"{_TERM} AS expected")), digits=3))

# --- whole runs; x0, fac, sn and kappa are what the files hold
_FACF = "fac AS (SELECT event_id, " + _float("add_fac") + " AS add_fac, " + _float("mul_fac") + f" AS mul_fac FROM (WITH {Q._FAC} SELECT * FROM fac))"
_X0 = f"x0 AS (SELECT vox, {_float('val')} AS val FROM img)"
_FILES = f"WITH {Q._LN}, {Q._IMG}, {_FACF}, {Q._seg()}, sn AS MATERIALIZED (SELECT vox, {_SENS} AS s FROM img), {_X0}, "
_EM = "iterative_algorithm_type = 0\nwarmup_setting = 1, 1\niteration_setting = 2, 1, 1\n"
_EM_SQL = f"{_FILES}{Q._em('x0', 'w1')}, {Q._em('w1', 'm1', 2, 0)}, {Q._em('m1', 'm2', 2, 1)}"
_DONE: dict = {}


def _em_run(spark: SparkSession, d: str) -> str:
    """The folder of what a run by ordered subsets after a warm-up has left; it is run once for each scan."""
    f = scan(spark, d)
    if f not in _DONE:
        _DONE.clear()
        run.reconstruct(spark, _settings(spark, d, _EM), f"{f}/em", projections=True)
        _DONE[f] = f"{f}/em"
    return _DONE[f]


for _name, _table, _part in (("run_em_image", "m2", "image"), ("run_em_warmup", "w1", "warmup"), ("run_em_intermediate", "m2", "intermediate/iter=1")):
    query(_name, f"{_EM_SQL} {Q._OUT}{_table}")(lambda spark, d, p=_part: Q.out(spark.read.parquet(f"{_em_run(spark, d)}/{p}")))
_LL = " UNION ALL ".join(f"SELECT '{phase}' AS phase, {n} AS iter, {m} AS subset, (SELECT sum(x.val * s) FROM {x} x JOIN sn USING (vox)) AS l1, (SELECT sum(CASE WHEN e + 1e-20 > 0 THEN ln(e + 1e-20) ELSE 0e0 END) FROM q{new}) AS l2" for phase, n, m, x, new in (("warmup", 1, 0, "x0", "w1"), ("main", 1, 0, "w1", "m1"), ("main", 1, 1, "m1", "m2")))
query("run_em_likelihood", f"{_EM_SQL}, ll AS ({_LL}) SELECT phase, CAST(iter AS BIGINT) AS iter, CAST(subset AS BIGINT) AS subset, {Q._r('l1', 'l1', 2)}, {Q._r('l2', 'l2', 2)}, {Q._r('l2 - l1', 'll', 2)} FROM ll")(lambda spark, d: Q.out(spark.read.parquet(f"{_em_run(spark, d)}/likelihood"), "phase", "iter", "subset", "l1", "l2", "ll", digits=2))
_PX = " UNION ALL ".join(f"SELECT '{name}' AS name, '{phase}' AS phase, {m} AS subset, event_id, {v} AS val FROM q{new} JOIN fac USING (event_id)" for phase, m, new in (("warmup", 0, "w1"), ("main", 0, "m1"), ("main", 1, "m2")) for name, v in (("Px", "e - add_fac"), ("Px_r_s", "e")))
query("run_em_projections", f"{_EM_SQL}, px AS ({_PX}) SELECT name, phase, CAST(subset AS BIGINT) AS subset, CAST(event_id AS BIGINT) AS event_id, {Q._r('val', 'val', 3)} FROM px")(lambda spark, d: Q.out(spark.read.parquet(f"{_em_run(spark, d)}/projection"), "name", "phase", "subset", "event_id", "val", digits=3))


def _line_section(spark: SparkSession, d: str) -> DataFrame:
    f = scan(spark, d)
    run.line_section(spark, _settings(spark, d, _EM.replace("warmup_setting = 1, 1\n", "")), f"{f}/section")
    return Q.out(raw.read_volume(spark, f"{f}/section/image.img", SMALL), digits=3)


query("run_line_section", f"{_FILES}{Q._em('x0', 'm1', 2, 0)}, {Q._em('m1', 'm2', 2, 1)} SELECT CAST(vox AS BIGINT) AS vox, {Q._r(_float('val'), 'val', 3)} FROM m2")(_line_section)
# blurred, with a penalty whose weight is a volume
_PSF = "iPSF_model = {f}/trans.mat, {f}/axial.mat\n"
_MAP = _PSF + "iterative_algorithm_type = 0\niteration_setting = 1, 0, 1\nregularizer_strength = 0.02\nregularizer_model_type = 0\nregularizer_potential_function_type = {{}}\nregularizer_neighborhood_properties = 1, 0\nregularizer_buildin_parameter_list = 0.3\nregularizer_spatial_variant_weight = {f}/kappa.img\n"
_PS = Q._PSF.replace(" AS a FROM", " AS a0 FROM").replace("bt AS (", "bt_ AS (").replace("ba AS (", "ba_ AS (") + f", bt AS (SELECT row, col, {_float('a0')} AS a FROM bt_), ba AS (SELECT row, col, {_float('a0')} AS a FROM ba_)"
_BLUR = lambda x, v, to, of: f"(SELECT bt.{to} + 256 * ba.{to} AS vox, sum({v} * bt.a * ba.a) AS {v} FROM {x} JOIN bt ON bt.{of} = vox % 256 JOIN ba ON ba.{of} = vox // 256 GROUP BY ALL)"
_PSF_SQL = (f"WITH {Q._LN}, {Q._IMG}, {_FACF}, {Q._seg()}, {_PS}, {_X0}, s0 AS (SELECT vox, {_SENS} AS s FROM img), sn AS MATERIALIZED {_BLUR('s0', 's', 'col', 'row')}, bx AS MATERIALIZED {_BLUR('x0', 'val', 'row', 'col')}, "
            "qb AS MATERIALIZED (SELECT event_id, coalesce(y, 0e0) + add_fac AS e, mul_fac FROM fac LEFT JOIN (SELECT event_id, sum(val * len) AS y FROM seg JOIN bx USING (vox) GROUP BY event_id) USING (event_id)), "
            f"z0 AS (SELECT vox, sum(len * CASE WHEN e > 0 THEN mul_fac / e ELSE 0e0 END) AS z FROM seg JOIN qb USING (event_id) GROUP BY vox), zb AS {_BLUR('z0', 'z', 'col', 'row')}")  # fmt: skip
query("run_em_blurred", f"{_PSF_SQL} SELECT CAST(x0.vox AS BIGINT) AS vox, {Q._r('x0.val * coalesce(z, 0e0) / s', 'val')} FROM x0 JOIN sn USING (vox) LEFT JOIN zb USING (vox)")(
    lambda spark, d: Q.out(run.reconstruct(spark, _settings(spark, d, _PSF + "iterative_algorithm_type = 0\niteration_setting = 1, 0, 1\n"))[0]))
_MAP_SQL = f"{_PSF_SQL}, {Q._NB[1]}, im AS (SELECT img.vox, i, j, k, x0.val, {_float('kappa')} AS kappa FROM img JOIN x0 USING (vox)), {Q._PR.replace('img', 'im')}, tt AS (SELECT v AS vox, sum(4e0 * w * gk) AS t1, sum(2e0 * w * gk * d) AS t2 FROM (SELECT *, {Q.slope_over_t('huber', 'd', 0.3)} AS w FROM pr) GROUP BY v)"
query("run_map_em", f"{_MAP_SQL}, ab AS (SELECT vox, 0.02e0 * t1 AS a, s - 0.02e0 * (t1 * x0.val - t2) AS b, x0.val * coalesce(z, 0e0) AS c FROM x0 JOIN tt USING (vox) JOIN sn USING (vox) LEFT JOIN zb USING (vox)) SELECT CAST(vox AS BIGINT) AS vox, {Q._r('CASE WHEN b + sqrt(b * b + 4 * a * c) > 0 THEN 2 * c / (b + sqrt(b * b + 4 * a * c)) ELSE 0e0 END', 'val')} FROM ab")(
    lambda spark, d: Q.out(run.reconstruct(spark, _settings(spark, d, _MAP.replace("{{}}", "3")))[0]))
_PATCH = "regularizer_model_type = 1\nregularizer_potential_function_type = 1\nregularizer_neighborhood_properties = 0, 0\nregularizer_buildin_parameter_list = 0.3\nregularizer_spatial_variant_weight = {f}/kappa.img\n"
query("run_patch_penalty", f"WITH {Q._IMG.replace('AS kappa FROM', 'AS kappa_ FROM').replace('img AS MATERIALIZED (', 'img_ AS MATERIALIZED (')}, img AS (SELECT vox, i, j, k, val, {_float('kappa_')} AS kappa FROM img_), {Q._NB[0]}, {Q._CUBE}, {Q._PP}, {Q._PA} {Q._PT.format(t1=Q._T1, t2=Q._T2)}")(
    lambda spark, d: Q.out(run.penalty(spark, _settings(spark, d, _PATCH))(Q.image(spark, d).drop("kappa"))))
_KMF = f"km AS (SELECT row, col, {_float('a')} AS a FROM (WITH {Q._KM} SELECT * FROM km))"
_KEM = "iterative_algorithm_type = 2\nkernel_matrix = {f}/kernel.mat\niteration_setting = 2, 1, 1\n"


def _kem_sql(x: str, new: str, alpha: str, m: int) -> str:
    return (f"{Q._em(x, new, 2, m)}, a{new} AS MATERIALIZED (SELECT al.vox, CASE WHEN s > 0 THEN al.val * coalesce(t, 0e0) / (s / 2) ELSE 0e0 END AS val FROM {alpha} al LEFT JOIN (SELECT row AS vox, sum(a * z) AS t FROM km JOIN z{new} ON col = vox GROUP BY row) k USING (vox) JOIN sn USING (vox)), "
            f"k{new} AS MATERIALIZED (SELECT row AS vox, sum(a * val) AS val FROM km JOIN a{new} ON col = vox GROUP BY row)")  # fmt: skip


def _kem_run(spark: SparkSession, d: str, part: str) -> DataFrame:
    f = scan(spark, d)
    run.reconstruct(spark, _settings(spark, d, _KEM), f"{f}/kem")
    return Q.out(spark.read.parquet(f"{f}/kem/{part}"))


_KEM_SQL = f"{_FILES}{_KMF}, one AS (SELECT vox, 1e0 AS val FROM img), {_kem_sql('x0', 'p', 'one', 0)}, {_kem_sql('kp', 'r', 'ap', 1)}"
query("run_kem_image", f"{_KEM_SQL} {Q._OUT}kr")(lambda spark, d: _kem_run(spark, d, "image"))
query("run_kem_alpha", f"{_KEM_SQL} {Q._OUT}ar")(lambda spark, d: _kem_run(spark, d, "intermediate_alpha/iter=1"))
_ADMM = "iterative_algorithm_type = 1\niteration_setting = 1, 1, 1\nregularizer_strength = 0.5\nregularizer_model_type = 0\n"
query("run_admm", f"{_FILES}{Q._em('x0', 'xn')}, {Q._NB[0]}, {Q._admm(10, 0.5).replace('val FROM img', 'x0.val FROM img JOIN x0 USING (vox)').replace('SELECT vox, i, j, k, x0', 'SELECT img.vox, i, j, k, x0')}, ab AS (SELECT vox, s - 0.5e0 * u10.val AS b, x0.val * coalesce(z, 0e0) AS c FROM x0 JOIN u10 USING (vox) JOIN sn USING (vox) LEFT JOIN zxn USING (vox)) SELECT CAST(vox AS BIGINT) AS vox, {Q._r('CASE WHEN b + sqrt(b * b + 2 * c) > 0 THEN 2 * c / (b + sqrt(b * b + 2 * c)) ELSE 0e0 END', 'val')} FROM ab")(
    lambda spark, d: Q.out(run.reconstruct(spark, _settings(spark, d, _ADMM))[0]))


def _lines_run(spark: SparkSession, d: str, exponential: bool) -> DataFrame:
    """The values that a run of line integrals has written, read again."""
    f = scan(spark, d)
    run.lines(spark, _settings(spark, d, "warmup_setting = 1, 1\n", "scan"), exponential, folder=f"{f}/lines{int(exponential)}")
    return Q.out(raw.records(spark, f"{f}/lines{int(exponential)}/image", np.dtype("<f4"), "event_id").withColumn("val", F.col("val").cast("double")), digits=3)


_LINE = f"WITH {Q._LN}, {Q._IMG}, {Q._seg()}, {_X0}, y AS (SELECT ev.event_id, coalesce(y, 0e0) AS y FROM ev LEFT JOIN (SELECT event_id, sum(val * len) AS y FROM seg JOIN x0 USING (vox) GROUP BY event_id) USING (event_id))"
query("run_lines", f"{_LINE} SELECT CAST(event_id AS BIGINT) AS event_id, {Q._r(_float('y'), 'val', 3)} FROM y")(lambda spark, d: _lines_run(spark, d, False))
query("run_lines_exponential", f"{_LINE} SELECT CAST(event_id AS BIGINT) AS event_id, {Q._r(_float('exp(-y)'), 'val', 3)} FROM y")(lambda spark, d: _lines_run(spark, d, True))
