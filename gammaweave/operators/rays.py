"""Rays through the image: each becomes rows of (voxel, length) without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formulas import _num, centre, cylinder, hit, inside, linear, voxel_of
from ..plans.scanner import LUT_SIZE, Scanner

TINY = 1e-30


def computed(rows: DataFrame) -> DataFrame:
    """The same rows, but with their columns computed once: what follows doesn't repeat the expressions, as it would in merged projections."""
    return rows.selectExpr("inline(array(named_struct(" + ", ".join(f"'{c}', `{c}`" for c in rows.columns) + ")))")


def fov_hits(lines: DataFrame, s: Scanner, kind: str = "box") -> DataFrame:
    """The lines that pass the field of view, with t0 and t1: box (3D), square (its x and y only) or cylinder."""
    if kind == "cylinder":
        det, t0, t1 = cylinder(s)
        return lines.where(f"{det} > 0e0").selectExpr("*", f"{t0} AS t0", f"{t1} AS t1")
    t0, t1 = hit(s, "xyz" if kind == "box" else "xy")
    return lines.selectExpr("*", f"{t0} AS t0", f"{t1} AS t1").where("t0 < t1")


def segments(lines: DataFrame, s: Scanner, *keep: str) -> DataFrame:
    """keep, i, j, k, vox and len: the exact lengths of each line in the voxels it passes.

    The crossings with all planes are sorted in the line's own row, and each pair of neighbours is a segment, whose voxel is
    that of its middle. Crossings of two planes that rounding parts (under 1e-9 mm) make no segment. Lines that miss the field of view have no rows.
    """
    plane = lambda p, d, n, v: f"transform(sequence(0, {n}), m -> ((m - {_num(n / 2)}) * {_num(v)} - {p}) / nullif({d}, 0e0))"
    crossings = f"concat(array(t0, t1), {plane('x0', 'dx', s.n, s.voxel)}, {plane('y0', 'dy', s.n, s.voxel)}, {plane('z0', 'dz', s.nk, s.voxel_k)})"
    rows = computed(fov_hits(lines, s)).selectExpr("*", f"array_sort(array_distinct(filter({crossings}, t -> t BETWEEN t0 AND t1))) AS ts")
    rows = rows.selectExpr("*", "explode(zip_with(slice(ts, 1, size(ts) - 1), slice(ts, 2, size(ts) - 1), (a, b) -> named_struct('a', a, 'b', b))) AS cut")
    rows = rows.selectExpr("*", "(cut.a + cut.b) / 2e0 AS tm", "(cut.b - cut.a) * sqrt(dx * dx + dy * dy + dz * dz) AS len")
    i, j, k = voxel_of(s, "x0 + tm * dx", "y0 + tm * dy", "z0 + tm * dz")
    return rows.selectExpr(*keep, f"{i} AS i", f"{j} AS j", f"{k} AS k", "len").where(f"len > 1e-9 AND {inside(s)}").selectExpr(*keep, "i", "j", "k", f"CAST({linear(s)} AS INT) AS vox", "len")


def samples(lines: DataFrame, s: Scanner, *keep: str) -> DataFrame:
    """keep, i, j, k, vox and len by one nearest voxel for each plane of the line's major axis; len is the slope's weight, without z or voxel size.

    Samples outside the volume (the field of view is only checked in x and y) have no row.
    """
    n, v, h = s.n, _num(s.voxel), _num(s.n * s.voxel / 2)
    rows = fov_hits(lines, s, "square").selectExpr("*", "abs(dx) > abs(dy) AS flat")
    index = lambda p, d, t: f"CAST(floor(({p} + {t} * {d} + {h}) / {v}) AS INT)"
    rows = rows.selectExpr("*", f"CASE WHEN flat THEN {index('x0', 'dx', 't0')} ELSE {index('y0', 'dy', 't0')} END AS m0", f"CASE WHEN flat THEN {index('x0', 'dx', 't1')} ELSE {index('y0', 'dy', 't1')} END AS m1")
    rows = rows.selectExpr("*", "explode(sequence(least(m0, m1), greatest(m0, m1))) AS m")
    rows = rows.selectExpr("*", f"({centre(n, s.voxel, 'm')} - CASE WHEN flat THEN x0 ELSE y0 END) / nullif(CASE WHEN flat THEN dx ELSE dy END, 0e0) AS tm")
    i, j, k = voxel_of(s, "x0 + tm * dx", "y0 + tm * dy", "z0 + tm * dz")
    rows = rows.selectExpr(*keep, f"CASE WHEN flat THEN {i} ELSE {n - 1} - m END AS i", f"CASE WHEN flat THEN m ELSE {j} END AS j", f"{k} AS k", "sqrt(1e0 + pow(CASE WHEN flat THEN dy / nullif(dx, 0e0) ELSE dx / nullif(dy, 0e0) END, 2)) AS len")
    return rows.where(inside(s)).selectExpr(*keep, "i", "j", "k", f"CAST({linear(s)} AS INT) AS vox", "len")


def tof_lut(spark: SparkSession, s: Scanner) -> DataFrame:
    return spark.createDataFrame(list(enumerate(s.lut())), "bin int, w double")


def tof_lines(lines: DataFrame, s: Scanner) -> DataFrame:
    """The lines cut to three sigma around their time bin (tbin_id), with the unit direction ux, uy, uz and the centre's place uc along it."""
    rows = lines.selectExpr("*", "sqrt(dx * dx + dy * dy + dz * dz) AS length").selectExpr("*", "dx / length AS ux", "dy / length AS uy", "dz / length AS uz", "(x0 + x1) / 2e0 AS cx", "(y0 + y1) / 2e0 AS cy", "(z0 + z1) / 2e0 AS cz", f"tbin_id * {_num(s.spacing)} AS off")
    reach = _num(3 * s.sigma)
    ends = {f"{a}{e}": f"c{a} + (off {'-' if e == '0' else '+'} {reach}) * u{a}" for a in "xyz" for e in "01"}
    rest = [c for c in lines.columns if c not in {*ends, "dx", "dy", "dz"}]
    rows = rows.selectExpr(*rest, *(f"{x} AS {c}" for c, x in ends.items()), "ux", "uy", "uz", "ux * (cx + off * ux) + uy * (cy + off * uy) + uz * (cz + off * uz) AS uc")
    return computed(computed(rows).selectExpr("*", "x1 - x0 AS dx", "y1 - y0 AS dy", "z1 - z0 AS dz"))


def _weighted(rows: DataFrame, s: Scanner, keep: tuple[str, ...]) -> DataFrame:
    """Lengths times the share of the Gaussian at their voxel's distance from the time bin; beyond three sigma there is no row."""
    far = f"abs(ux * {centre(s.n, s.voxel, 'j')} + uy * {centre(s.n, s.voxel, 'i', True)} + uz * {centre(s.nk, s.voxel_k, 'k')} - uc)"
    rows = rows.selectExpr(*keep, "i", "j", "k", "vox", "len", f"CAST(floor({far} / {_num(s.lut_step)}) AS INT) AS bin").where(f"bin < {LUT_SIZE}")
    return rows.join(F.broadcast(tof_lut(rows.sparkSession, s)), "bin").selectExpr(*keep, "i", "j", "k", "vox", "len * w AS len")


def tof_segments(lines: DataFrame, s: Scanner, *keep: str) -> DataFrame:
    """As segments, weighted by time of flight."""
    return _weighted(segments(tof_lines(lines, s), s, *keep, "ux", "uy", "uz", "uc"), s, keep)


def tof_samples(lines: DataFrame, s: Scanner, *keep: str) -> DataFrame:
    """As samples, weighted by time of flight."""
    return _weighted(samples(tof_lines(lines, s), s, *keep, "ux", "uy", "uz", "uc"), s, keep)


TRACERS = {"siddon": segments, "bresenham": samples, "tof": tof_segments, "tof_bresenham": tof_samples}
