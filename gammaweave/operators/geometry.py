"""Crystals, rings, image planes and lines of response."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formulas import _num, centre, linear
from ..plans.scanner import MOST_BROADCAST, Scanner


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it has few enough rows, else for a merge join, as Spark's own choice goes by estimates, which miss what functions and explosions make on the other side."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df.hint("merge")


def _crystal(s: Scanner, id_: str) -> tuple[str, str]:
    """SQL expressions of the x and y of a crystal's centre: module by module, along its tangent."""
    a = f"radians(({id_} div {s.crystals}) * {_num(360 / s.modules)} + {_num(180 / s.modules if s.half_step else 0)})"
    t = f"({_num(s.pitch)} * ({id_} % {s.crystals} - {_num(s.crystals / 2 - 0.5)}))"
    r = _num((s.ring_diameter + s.depth) / 2)
    return f"{r} * cos({a}) - {t} * sin({a})", f"{r} * sin({a}) + {t} * cos({a})"


def _ring(s: Scanner, id_: str) -> str:
    return f"({id_} - {_num(s.rings / 2 - 0.5)}) * {_num(s.ring_pitch)}"


def crystal_positions(spark: SparkSession, s: Scanner) -> DataFrame:
    """xtal_id, x, y of crystal centres."""
    x, y = _crystal(s, "id")
    return spark.range(s.per_ring).selectExpr("CAST(id AS INT) AS xtal_id", f"{x} AS x", f"{y} AS y")


def ring_positions(spark: SparkSession, s: Scanner) -> DataFrame:
    return spark.range(s.rings).selectExpr("CAST(id AS INT) AS ring_id", f"{_ring(s, 'id')} AS z")


def planes(spark: SparkSession, s: Scanner) -> DataFrame:
    """axis, index and the centre of each plane of voxels."""
    out = None
    for axis, n, v, back in (("x", s.n, s.voxel, False), ("y", s.n, s.voxel, True), ("z", s.nk, s.voxel_k, False)):
        p = spark.range(n).selectExpr(f"'{axis}' AS axis", "CAST(id AS INT) AS index", f"{centre(n, v, 'id', back)} AS centre")
        out = p if out is None else out.union(p)
    return out


def grid(spark: SparkSession, s: Scanner) -> DataFrame:
    """vox, i, j, k of all voxels; i runs fastest."""
    return spark.range(s.voxels).selectExpr("CAST(id AS INT) AS vox", f"CAST(id % {s.n} AS INT) AS i", f"CAST(id div {s.n} % {s.n} AS INT) AS j", f"CAST(id div {s.n * s.n} AS INT) AS k")


def unknown_ids(events: DataFrame, s: Scanner) -> int:
    """How many events name a crystal or ring that the scanner lacks; lines_of_response fails on them."""
    return events.where(f"NOT (xtal_id_1 BETWEEN 0 AND {s.per_ring - 1} AND xtal_id_2 BETWEEN 0 AND {s.per_ring - 1} AND ring_id_1 BETWEEN 0 AND {s.rings - 1} AND ring_id_2 BETWEEN 0 AND {s.rings - 1})").count()


def lines_of_response(events: DataFrame, s: Scanner) -> DataFrame:
    """events with both ends x0, y0, z0 and x1, y1, z1 and the differences dx, dy, dz, computed in the event's own row: no join, and nothing for the driver to broadcast.

    An event that names a crystal or ring that the scanner lacks, or none, is an error where its ends are used.
    """
    known = lambda x, id_, n: f"CASE WHEN {id_} BETWEEN 0 AND {n - 1} THEN {x} ELSE CAST(raise_error('an event names a crystal or ring that the scanner lacks') AS DOUBLE) END"
    ends = []
    for end, id_ in (("0", "1"), ("1", "2")):
        xtal, ring = f"CAST(xtal_id_{id_} AS BIGINT)", f"CAST(ring_id_{id_} AS BIGINT)"
        ends += [f"'{a}{end}', {known(x, xtal, s.per_ring)}" for a, x in zip("xy", _crystal(s, xtal), strict=True)]
        ends.append(f"'z{end}', {known(_ring(s, ring), ring, s.rings)}")
    # made by a generator of one row, as Spark would repeat plain expressions wherever a later one names an end
    rows = events.selectExpr(*(f"`{c}`" for c in events.columns), f"inline(array(named_struct({', '.join(ends)})))")
    return rows.selectExpr("*", "x1 - x0 AS dx", "y1 - y0 AS dy", "z1 - z0 AS dz")


def crystal_pairs(spark: SparkSession, s: Scanner, bins: int, compressed: bool = False) -> DataFrame:
    """angle, bin and the two crystals of each bin of a sinogram; an even number of bins is one more.

    At the first angle the two arms run away from the central pair, and each step moves one end; all other angles are turns of it.
    compressed leaves out what 8-fold (or 4-fold) symmetry gives back.
    """
    if s.modules % 2:
        raise ValueError("an odd number of modules has no opposite crystals")
    nx, na, nt, bins = s.per_ring, s.per_ring // 2, s.crystals, bins + (bins % 2 == 0)
    odd = nt % 2
    if s.half_step:
        steps = na // 2 * 2 - 2
        first, second = f"pmod({steps // 2 - 1} - c, {nx})", f"{na - steps // 2} + c"
    else:
        steps = na // 2 * 2 - odd
        first = f"pmod({nt // 2 + steps // 2 - (0 if odd else 1)} - c, {nx})"
        second = f"{nx // 2 + nt // 2 - (0 if odd else 1) - steps // 2 + (0 if odd else 1)} + c"
    total = 2 * steps - 1
    if total < bins:
        raise ValueError(f"{bins} bins are more than the {total} pairs of an angle")
    place = f"(bin + {total // 2 - bins // 2})"
    rows = spark.range(na * bins).selectExpr(f"CAST(id div {bins} AS INT) AS angle", f"CAST(id % {bins} AS INT) AS bin")
    # place p: step p div 2 of the first arm, and that of the second, or (p odd) one further
    rows = rows.selectExpr("angle", "bin", f"{place} div 2 AS c0", f"({place} + 1) div 2 AS c1")
    rows = rows.selectExpr("angle", "bin", f"CAST(({first.replace(' c', ' c0')} + angle) % {nx} AS INT) AS xtal_1", f"CAST(({second.replace(' c', ' c1')} + angle) % {nx} AS INT) AS xtal_2")
    if compressed:
        angles = na // 4 + 1 if s.modules % 4 == 0 else na // 2 + 1
        rows = rows.where(f"angle < {angles} AND bin <= {bins // 2}")
    return rows


def with_vox(df: DataFrame, s: Scanner) -> DataFrame:
    return df.withColumn("vox", F.expr(f"CAST({linear(s)} AS INT)"))
