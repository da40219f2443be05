"""Registered queries of the tomography engine and their DuckDB oracles.

Events, images and matrices follow from the driver's `events` by formulas that hold in both engines. The oracles are written with
joins, windows and unions, and with formulas and numbers of their own for the small scanner; the engine's own plans and formulas are not.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formulas
from .functions.formulas import POTENTIALS, _num
from .operators import geometry as G
from .operators import knn as N
from .operators import penalty as R
from .operators import project as A
from .operators import rays as T
from .operators import sparse as P
from .plans import config, recon
from .plans.scanner import LUT_SIZE, SMALL, Scanner

S = SMALL
WIDE = Scanner(n=64, nk=2)
#: (id, x, y) of the events of the small scanner.
_EVENTS = "SELECT event_id, CAST(event_id % 48 AS INT) AS xtal_id_1, CAST((event_id % 48 + 24 + user_id % 17 - 8) % 48 AS INT) AS xtal_id_2, CAST(event_id * 7 % 8 AS INT) AS ring_id_1, CAST(user_id * 3 % 8 AS INT) AS ring_id_2, CAST(event_id % 5 - 2 AS INT) AS tbin_id FROM events"
_ADD = "SELECT event_id, 0.1e0 * (event_id % 5) AS add_fac FROM events WHERE event_id % 3 <> 0"
_MUL = "SELECT event_id, 1e0 + 0.05e0 * (event_id % 7) AS mul_fac FROM events WHERE event_id % 4 <> 1"
#: Of a voxel with c events, whose numbers sum to t.
_VAL, _KAPPA = "1e0 + coalesce(t / (97e0 * c), (vox * 7919 % 97) / 97e0)", "1e0 + (coalesce(c, 0) % 5) / 10e0"
#: Events for each eight planes of the images that grow with them.
_EACH = 10_000
_DELTA, _BETA = 0.3, 0.02
_CONFIG = ["# a scanner", "image_size = 16, 16, 8", "", "voxel_size = 4, 4, 4 # mm", "detector_ring_diameter = 120", "crystal_size = 7.9, 7.9, 4, 10", "colour = blue", "a = b = c", "novalue =", "image_size = 1,1,1", "crystal_array_size = 4, 1"]


def _sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    head, _, rest = sql.partition(" FROM events")
    expressions = [x.strip() for x in _split(head.removeprefix("SELECT "))]
    return (events.where(rest.replace(" WHERE ", "")) if rest.strip() else events).selectExpr(*expressions)


def _split(text: str) -> list[str]:
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def events(spark, d) -> DataFrame:
    return _sql(spark, d, _EVENTS)


def lines(spark, d) -> DataFrame:
    return G.lines_of_response(events(spark, d), S)


def full_events(spark, d) -> DataFrame:
    return A.with_factors(events(spark, d), _sql(spark, d, _ADD), _sql(spark, d, _MUL))


def image(spark, d: str | None = None, s: Scanner = S) -> DataFrame:
    """The grid with values and weights from the events that fall to each voxel."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id") if d else spark.range(0).selectExpr("id AS event_id", "id AS user_id")
    sums = rows.selectExpr(f"CAST(event_id % {s.voxels} AS INT) AS vox", "(event_id * 31 + user_id) % 97 AS t").groupBy("vox").agg(F.count("*").alias("c"), F.sum("t").alias("t"))
    return G.grid(spark, s).join(sums, "vox", "left").selectExpr("vox", "i", "j", "k", f"{_VAL} AS val", f"{_KAPPA} AS kappa")


def grown(spark, d: str) -> Scanner:
    """The small scanner with as many planes as the events ask for."""
    return replace(S, nk=8 * max(1, -(-spark.read.parquet(f"{d}/events.parquet").count() // _EACH)))


def volume(spark, d: str) -> tuple[DataFrame, Scanner]:
    s = grown(spark, d)
    return image(spark, d, s), s


def out(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """The columns, doubles rounded and without negative zeros, counts as long."""
    kind = dict(df.dtypes)
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if kind[c] == "double" else F.col(c).cast("long").alias(c) if kind[c] in ("int", "bigint", "smallint") else F.col(c) for c in columns or df.columns))


def psf(spark) -> tuple[DataFrame, DataFrame]:
    make = lambda n, a, b, c: spark.range(n).selectExpr("CAST(id AS INT) AS row", "explode(array(-1, 0, 1)) AS o").selectExpr("row", "row + o AS col", f"CASE o WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END AS val").where(f"col BETWEEN 0 AND {n - 1}")
    return make(S.n * S.n, "0.5e0", "0.3e0", "0.2e0"), make(S.nk, "0.6e0", "0.25e0", "0.15e0")


def kernel(spark) -> DataFrame:
    return spark.range(S.voxels).selectExpr("CAST(id AS INT) AS row", "explode(array(-1, 0, 1)) AS o").selectExpr("row", "row + o AS col", "CASE o WHEN 0 THEN 0.6e0 ELSE 0.2e0 END AS val").where(f"col BETWEEN 0 AND {S.voxels - 1}")


def matrix(spark, d) -> DataFrame:
    return _sql(spark, d, "SELECT CAST(event_id % 40 AS INT) AS row, CAST(user_id % 60 AS INT) AS col, 1e0 + event_id % 9 AS v FROM events WHERE event_id % 7 <> 3 AND event_id % 40 <> 11").groupBy("row", "col").agg(F.sum("v").alias("val"))


def problem(spark, d, **options) -> recon.Problem:
    return recon.Problem(full_events(spark, d), S, **options)


# --- the oracles' own formulas, for the small scanner: 16 x 16 x 8 voxels of 4 mm around the origin
_HALF = {"x": "30e0", "y": "30e0", "z": "14e0"}


def hit(axes: str = "xyz") -> tuple[str, str]:
    enter = [f"CASE WHEN d{a} <> 0 THEN least((-{_HALF[a]} - {a}0) / d{a}, ({_HALF[a]} - {a}0) / d{a}) WHEN abs({a}0) <= {_HALF[a]} THEN 0e0 ELSE 9e0 END" for a in axes]
    leave = [f"CASE WHEN d{a} <> 0 THEN greatest((-{_HALF[a]} - {a}0) / d{a}, ({_HALF[a]} - {a}0) / d{a}) WHEN abs({a}0) <= {_HALF[a]} THEN 1e0 ELSE -9e0 END" for a in axes]
    return f"greatest(0e0, {', '.join(enter)})", f"least(1e0, {', '.join(leave)})"


#: A circle of 30 mm: roots of a t^2 + 2 b t + c.
_A, _B, _C = "(dx * dx + dy * dy)", "(dx * x0 + dy * y0)", "(x0 * x0 + y0 * y0 - 900e0)"
_DISC = f"({_B} * {_B} - {_A} * {_C})"
_IJK = "CAST(floor((32e0 - (y0 + tm * dy)) / 4e0) AS INT)", "CAST(floor((x0 + tm * dx + 32e0) / 4e0) AS INT)", "CAST(floor((z0 + tm * dz + 16e0) / 4e0) AS INT)"
_INSIDE, _VOX = "i >= 0 AND i < 16 AND j >= 0 AND j < 16 AND k >= 0 AND k < 8", "CAST(i + 16 * j + 256 * k AS INT)"
_CENTRES = "((j - 7.5e0) * 4e0)", "((7.5e0 - i) * 4e0)", "((k - 3.5e0) * 4e0)"
#: Time of flight: 300 ps of resolution and bins of 200 ps, at 0.15 mm a ps; 512 steps to three sigma.
_SIGMA, _BIN = "(45e0 / 2.355e0)", "30e0"
_ERF = "(2e0 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda n: CASE WHEN n % 2 = 0 THEN 1e0 ELSE -1e0 END * pow({x}, 2 * n + 1) / (gamma(n + 1e0) * (2 * n + 1)))))"
_LUT = f"lut AS MATERIALIZED (SELECT CAST(b AS INT) AS bin, ({_ERF.format(x=f'((b * 3e0 * {_SIGMA} / 512e0 + 15e0) / ({_SIGMA} * sqrt(2e0)))')} - {_ERF.format(x=f'((b * 3e0 * {_SIGMA} / 512e0 - 15e0) / ({_SIGMA} * sqrt(2e0)))')}) / 2e0 AS w FROM range(512) t(b))"


def phi(kind: str, t: str, d: float) -> str:
    return {
        "quad": f"pow({t}, 2)", "hyperbola": f"sqrt(pow({t}, 2) + {d})", "fair": f"{t} - {d} * ln(1 + abs({t}) / {d})", "huber": f"CASE WHEN abs({t}) > {d} THEN {d} * (abs({t}) - {d} / 2) ELSE pow({t}, 2) / 2 END",
        "hl": f"{d} * {d} * ln(1 + pow({t} / {d}, 2)) / 2", "hw": f"1 - exp(-pow({t} / {d}, 2))",
    }[kind]


def slope_over_t(kind: str, t: str, d: float) -> str:
    return {
        "quad": "2e0", "hyperbola": f"pow(pow({t}, 2) + {d}, -0.5)", "fair": f"1e0 / ({d} + abs({t}))", "huber": f"least(1e0, {d} / nullif(abs({t}), 0))", "hl": f"{d} * {d} / ({d} * {d} + pow({t}, 2))", "hw": f"exp(-pow({t} / {d}, 2))",
    }[kind]


def slope(kind: str, t: str, d: float) -> str:
    return f"greatest(-{d}, least({d}, {t}))" if kind == "huber" else f"({t}) * {slope_over_t(kind, t, d)}"


# --- oracle parts -------------------------------------------------------------------------------------------------------
_CR = f"cr AS (SELECT CAST(id AS INT) AS xtal_id, {_num((S.ring_diameter + S.depth) / 2)} * cos(radians(id // {S.crystals} * 30e0)) + {_num(S.pitch)} * (id % {S.crystals} - 1.5e0) * cos(radians(id // {S.crystals} * 30e0 + 90e0)) AS x, {_num((S.ring_diameter + S.depth) / 2)} * sin(radians(id // {S.crystals} * 30e0)) + {_num(S.pitch)} * (id % {S.crystals} - 1.5e0) * sin(radians(id // {S.crystals} * 30e0 + 90e0)) AS y FROM range({S.per_ring}) t(id))"
_RG = f"rg AS (SELECT CAST(id AS INT) AS ring_id, (id - 3.5e0) * {_num(S.ring_pitch)} AS z FROM range({S.rings}) t(id))"
_EV = f"ev AS ({_EVENTS})"
_LN = f"{_EV}, {_CR}, {_RG}, ln_ AS (SELECT ev.*, a.x AS x0, a.y AS y0, e.z AS z0, b.x AS x1, b.y AS y1, f.z AS z1 FROM ev JOIN cr a ON a.xtal_id = xtal_id_1 JOIN cr b ON b.xtal_id = xtal_id_2 JOIN rg e ON e.ring_id = ring_id_1 JOIN rg f ON f.ring_id = ring_id_2), ln AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy, z1 - z0 AS dz FROM ln_)"
def _img(planes: str, n: int = 16) -> str:
    return (
        f"pl AS (SELECT {planes} AS nk FROM events), me AS (SELECT event_id % ({n * n} * nk) AS vox, count(*) AS c, sum((event_id * 31 + user_id) % 97) AS t FROM events, pl GROUP BY ALL), "
        f"gr AS (SELECT unnest(range({n * n} * nk)) AS vox FROM pl), "
        f"img AS MATERIALIZED (SELECT CAST(vox AS INT) AS vox, vox % {n} AS i, vox // {n} % {n} AS j, vox // {n * n} AS k, {_VAL} AS val, {_KAPPA} AS kappa FROM gr LEFT JOIN me USING (vox))"
    )


#: Of the small scanner, and with planes by the number of events.
_IMG, _VIMG = _img("max(8)"), _img(f"8 * greatest(1, (count(*) + {_EACH - 1}) // {_EACH})")
_FAC = f"fac AS (SELECT ev.event_id, coalesce(add_fac, 0e0) AS add_fac, coalesce(mul_fac, 1e0) AS mul_fac FROM ev LEFT JOIN ({_ADD}) a USING (event_id) LEFT JOIN ({_MUL}) m USING (event_id))"


def _seg(source: str = "ln") -> str:
    """h and seg: crossings as rows, neighbours by a window."""
    t0, t1 = hit()
    cross = " UNION ALL ".join(f"SELECT event_id, t0, t1, ((m - {_num(n / 2)}) * {_num(v)} - {a}0) / nullif(d{a}, 0e0) AS t FROM h, range({n + 1}) g(m)" for a, n, v in (("x", S.n, S.voxel), ("y", S.n, S.voxel), ("z", S.nk, S.voxel_k)))
    i, j, k = _IJK
    return (f"h AS (SELECT * FROM (SELECT *, {t0} AS t0, {t1} AS t1 FROM {source}) WHERE t0 < t1), "
            f"cx AS (SELECT event_id, t0 AS t FROM h UNION SELECT event_id, t1 FROM h UNION SELECT event_id, t FROM ({cross}) WHERE t BETWEEN t0 AND t1), "
            "nx AS (SELECT event_id, t AS a, lead(t) OVER (PARTITION BY event_id ORDER BY t) AS b FROM cx), "
            "sg_ AS (SELECT h.*, (a + b) / 2e0 AS tm, (b - a) * sqrt(dx * dx + dy * dy + dz * dz) AS len FROM nx JOIN h USING (event_id) WHERE (b - a) * sqrt(dx * dx + dy * dy + dz * dz) > 1e-9), "
            f"sg AS (SELECT *, {i} AS i, {j} AS j, {k} AS k FROM sg_), seg AS MATERIALIZED (SELECT *, {_VOX} AS vox FROM sg WHERE {_INSIDE})")  # fmt: skip


def _bres(source: str = "ln") -> str:
    t0, t1 = hit("xy")
    n, v, h = S.n, _num(S.voxel), _num(S.n * S.voxel / 2)
    part = lambda a, o, flat: (
        f"SELECT event_id, i, j, k, len FROM (SELECT event_id, m, {'m' if flat else 'jj'} AS j, {'ii' if flat else f'{n - 1} - m'} AS i, kk AS k, len FROM (SELECT event_id, m, "
        + ", ".join(f"{e} AS {c}" for e, c in zip(_IJK, ("ii", "jj", "kk"), strict=True))
        + f", sqrt(1e0 + pow(d{o} / d{a}, 2)) AS len FROM (SELECT *, ((m - 7.5e0) * 4e0 - {a}0) / d{a} AS tm FROM b, range({n}) g(m) WHERE {'' if flat else 'NOT '}(abs(dx) > abs(dy)) AND m BETWEEN least(floor(({a}0 + t0 * d{a} + {h}) / {v}), floor(({a}0 + t1 * d{a} + {h}) / {v})) AND greatest(floor(({a}0 + t0 * d{a} + {h}) / {v}), floor(({a}0 + t1 * d{a} + {h}) / {v})))))"
    )
    return f"b AS (SELECT * FROM (SELECT *, {t0} AS t0, {t1} AS t1 FROM {source}) WHERE t0 < t1), bs AS ({part('x', 'y', True)} UNION ALL {part('y', 'x', False)}), seg AS (SELECT *, {_VOX} AS vox FROM bs WHERE {_INSIDE})"


def _tof(trace=None) -> str:
    far = f"abs(ux * {_CENTRES[0]} + uy * {_CENTRES[1]} + uz * {_CENTRES[2]} - uc)"
    return (f"{_LUT}, un AS (SELECT event_id, tbin_id, (x0 + x1) / 2e0 AS cx, (y0 + y1) / 2e0 AS cy, (z0 + z1) / 2e0 AS cz, dx / l AS ux, dy / l AS uy, dz / l AS uz, tbin_id * {_BIN} AS off FROM (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS l FROM ln)), "
            f"te AS (SELECT event_id, {', '.join(f'c{a} + (off - 3e0 * {_SIGMA}) * u{a} AS {a}0, c{a} + (off + 3e0 * {_SIGMA}) * u{a} AS {a}1' for a in 'xyz')}, ux, uy, uz, ux * (cx + off * ux) + uy * (cy + off * uy) + uz * (cz + off * uz) AS uc FROM un), "
            f"tl AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy, z1 - z0 AS dz FROM te), {(trace or _seg)('tl')}, ts AS (SELECT event_id, vox, len * w AS len FROM (SELECT g.event_id, vox, len, CAST(floor({far.replace('ux', 'te.ux').replace('uy', 'te.uy').replace('uz', 'te.uz').replace('uc', 'te.uc')} / (3e0 * {_SIGMA} / 512e0)) AS INT) AS bin FROM seg g JOIN te ON te.event_id = g.event_id) JOIN lut USING (bin))")  # fmt: skip


def _r(x: str, name: str, digits: int = 4) -> str:
    return f"round({x}, {digits}) + 0e0 AS {name}"


def _id(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_SPAN = "SELECT " + _id("event_id") + ", " + ", ".join(_r(c, c) for c in ("x0", "y0", "z0", "x1", "y1", "z1"))
_HITS = "ha AS (SELECT {0}, count(*) AS n_hits FROM (SELECT {0}_1 AS {0} FROM ev UNION ALL SELECT {0}_2 FROM ev) GROUP BY ALL)"


def _hits(spark, d, name: str) -> DataFrame:
    """How many events' ends are in each crystal or ring."""
    return events(spark, d).selectExpr(f"explode(array({name}_1, {name}_2)) AS {name}").groupBy(name).agg(F.count("*").alias("n_hits"))


query("crystal_positions", f"WITH {_EV}, {_CR}, {_HITS.format('xtal_id')} SELECT {_id('xtal_id')}, {_r('x', 'x')}, {_r('y', 'y')}, coalesce(n_hits, 0) AS n_hits FROM cr LEFT JOIN ha USING (xtal_id)")(
    lambda spark, d: out(G.crystal_positions(spark, S).join(_hits(spark, d, "xtal_id"), "xtal_id", "left").fillna(0, "n_hits")))
query("ring_positions", f"WITH {_EV}, {_RG}, {_HITS.format('ring_id')} SELECT {_id('ring_id')}, {_r('z', 'z')}, coalesce(n_hits, 0) AS n_hits FROM rg LEFT JOIN ha USING (ring_id)")(
    lambda spark, d: out(G.ring_positions(spark, S).join(_hits(spark, d, "ring_id"), "ring_id", "left").fillna(0, "n_hits")))
_PL = "SELECT 'x' AS axis, CAST(m AS BIGINT) AS index, (m - 7.5e0) * 4 AS centre FROM range(16) g(m) UNION ALL SELECT 'y', m, (7.5e0 - m) * 4 FROM range(16) g(m) UNION ALL SELECT 'z', m, (m - 3.5e0) * 4 FROM range(8) g(m)"
_MI = "SELECT 'x' AS axis, CAST(floor((x0 + x1) / 8e0 + 8e0 + 1e-7) AS BIGINT) AS index FROM ln UNION ALL SELECT 'y', CAST(floor(8e0 - (y0 + y1) / 8e0 + 1e-7) AS BIGINT) FROM ln UNION ALL SELECT 'z', CAST(floor((z0 + z1) / 8e0 + 4e0 + 1e-7) AS BIGINT) FROM ln"


def _middles(spark, d) -> DataFrame:
    """How many lines have their middle in each plane."""
    at = [("x", "(x0 + x1) / 2e0", S.n, S.voxel), ("y", "-(y0 + y1) / 2e0", S.n, S.voxel), ("z", "(z0 + z1) / 2e0", S.nk, S.voxel_k)]
    rows = lines(spark, d).selectExpr("inline(array(" + ", ".join(f"named_struct('axis', '{a}', 'index', CAST(floor(({m} + {n * v / 2}e0) / {v}e0 + 1e-7) AS INT))" for a, m, n, v in at) + "))")
    return rows.groupBy("axis", "index").agg(F.count("*").alias("n_lines"))


query("image_planes", f"WITH {_LN}, pl AS ({_PL}), mi AS (SELECT axis, index, count(*) AS n FROM ({_MI}) GROUP BY ALL) SELECT pl.*, coalesce(n, 0) AS n_lines FROM pl LEFT JOIN mi USING (axis, index)")(
    lambda spark, d: out(G.planes(spark, S).join(_middles(spark, d), ["axis", "index"], "left").fillna(0, "n_lines")))
query("lor_endpoints", f"WITH {_LN} {_SPAN} FROM ln")(lambda spark, d: out(lines(spark, d), "event_id", "x0", "y0", "z0", "x1", "y1", "z1"))
for _kind, _name, _axes in (("box", "fov_hit_box3d", "xyz"), ("square", "fov_hit_box2d", "xy")):
    _a, _b = hit(_axes)
    query(_name, f"WITH {_LN} SELECT {_id('event_id')}, {_r('t0', 't0')}, {_r('t1', 't1')} FROM (SELECT *, {_a} AS t0, {_b} AS t1 FROM ln) WHERE t0 < t1")(lambda spark, d, k=_kind: out(T.fov_hits(lines(spark, d), S, k), "event_id", "t0", "t1"))
query("fov_hit_cylinder", f"WITH {_LN} SELECT {_id('event_id')}, {_r(f'(-{_B} - sqrt({_DISC})) / {_A}', 't0')}, {_r(f'(-{_B} + sqrt({_DISC})) / {_A}', 't1')} FROM (SELECT * FROM ln WHERE {_DISC} > 0)")(lambda spark, d: out(T.fov_hits(lines(spark, d), S, "cylinder"), "event_id", "t0", "t1"))
query("siddon_segments", f"WITH {_LN}, {_seg()} SELECT {_id('event_id', 'i', 'j', 'k')}, {_r('len', 'len')} FROM seg")(lambda spark, d: out(T.segments(lines(spark, d), S, "event_id"), "event_id", "i", "j", "k", "len"))
query("sysmat_rows", f"WITH {_LN}, {_seg()} SELECT {_id('event_id', 'vox')}, {_r('sum(len)', 'len')} FROM seg GROUP BY event_id, vox")(lambda spark, d: out(A.system_matrix(lines(spark, d), S)))
query("sysmat_nnz", f"WITH {_LN}, {_seg()} SELECT {_id('event_id')}, count(DISTINCT vox) AS nnz, {_r('sum(len)', 'len')} FROM seg GROUP BY event_id")(lambda spark, d: out(A.system_matrix(lines(spark, d), S).groupBy("event_id").agg(F.count("*").alias("nnz"), F.sum("len").alias("len"))))
_FWD = "SELECT " + _id("ev.event_id").replace("AS ev.event_id", "AS event_id") + ", " + _r("coalesce(y, 0e0)", "y") + " FROM ev LEFT JOIN (SELECT event_id, sum(val * len) AS y FROM {} JOIN img USING (vox) GROUP BY event_id) f USING (event_id)"
query("siddon_forward", f"WITH {_LN}, {_IMG}, {_seg()} {_FWD.format('seg')}")(lambda spark, d: out(A.forward(lines(spark, d), image(spark, d), S)))
query("bresenham_forward", f"WITH {_LN}, {_IMG}, {_bres()} {_FWD.format('seg')}")(lambda spark, d: out(A.forward(lines(spark, d), image(spark, d), S, "bresenham")))
query("tof_forward", f"WITH {_LN}, {_IMG}, {_tof()} {_FWD.format('ts')}")(lambda spark, d: out(A.forward(lines(spark, d), image(spark, d), S, "tof")))
query("tof_bresenham_forward", f"WITH {_LN}, {_IMG}, {_tof(_bres)} {_FWD.format('ts')}")(lambda spark, d: out(A.forward(lines(spark, d), image(spark, d), S, "tof_bresenham")))
query("attenuation_factors", f"WITH {_LN}, {_IMG}, {_seg()} SELECT CAST(ev.event_id AS BIGINT) AS event_id, {_r('exp(-coalesce(y, 0e0) / 100e0)', 'factor', 6)} FROM ev LEFT JOIN (SELECT event_id, sum(val * len) AS y FROM seg JOIN img USING (vox) GROUP BY event_id) f USING (event_id)")(
    lambda spark, d: out(A.attenuation(lines(spark, d), image(spark, d).withColumn("val", F.col("val") / 100), S), digits=6))
query("line_integrals", f"WITH {_LN}, {_IMG}, {_seg()} SELECT * FROM ({_FWD.format('seg')}) WHERE event_id % 2 = 0")(lambda spark, d: out(recon.line_integrals(problem(spark, d, subsets=2), image(spark, d))))
_W = "(0.5e0 + event_id % 4)"
for _name, _extra, _from, _len, _trace in (("siddon_back", _seg(), "seg", "len", ("siddon", 1)), ("siddon_back_square", _seg(), "seg", "len * len", ("siddon", 2)), ("bresenham_back", _bres(), "seg", "len", ("bresenham", 1)), ("tof_back", _tof(), "ts", "len", ("tof", 1)), ("tof_bresenham_back", _tof(_bres), "ts", "len", ("tof_bresenham", 1))):
    query(_name, f"WITH {_LN}, {_extra} SELECT {_id('vox')}, {_r(f'sum({_len} * {_W})', 'val', 3)} FROM {_from} GROUP BY vox")(lambda spark, d, t=_trace: out(A.back(lines(spark, d).withColumn("w", F.expr(_W)), S, "w", *t), digits=3))
query("sensitivity", f"WITH {_LN}, {_seg()} SELECT {_id('vox')}, {_r('sum(len)', 'val', 3)} FROM seg GROUP BY vox")(lambda spark, d: out(A.sensitivity(lines(spark, d), S), digits=3))
query("bresenham_samples", f"WITH {_LN}, {_bres()} SELECT {_id('event_id', 'i', 'j', 'k')}, {_r('len', 'len')} FROM seg")(lambda spark, d: out(T.samples(lines(spark, d), S, "event_id"), "event_id", "i", "j", "k", "len"))
query("tof_endpoints", f"WITH {_LN}, {_tof()} {_SPAN} FROM te")(lambda spark, d: out(T.tof_lines(lines(spark, d), S), "event_id", "x0", "y0", "z0", "x1", "y1", "z1"))
_FAR = "sqrt(pow((x0 + x1) / 2e0, 2) + pow((y0 + y1) / 2e0, 2) + pow((z0 + z1) / 2e0, 2))"
query("tof_lut", f"WITH {_LN}, {_LUT}, fr AS (SELECT CAST(floor({_FAR} * 512e0 / (3e0 * {_SIGMA}) + 1e-7) AS INT) AS bin, count(*) AS n FROM ln GROUP BY ALL) SELECT CAST(bin AS BIGINT) AS bin, {_r('w', 'w', 9)}, coalesce(n, 0) AS n_lines FROM lut LEFT JOIN fr USING (bin)")(
    lambda spark, d: out(T.tof_lut(spark, S).join(lines(spark, d).selectExpr(f"CAST(floor({_FAR} / {S.lut_step!r} + 1e-7) AS INT) AS bin").groupBy("bin").agg(F.count("*").alias("n_lines")), "bin", "left").fillna(0, "n_lines"), digits=9))
query("subset_sizes", f"WITH {_EV} SELECT CAST(event_id % 3 AS BIGINT) AS subset_id, count(*) AS n_events FROM ev GROUP BY ALL")(lambda spark, d: out(A.subset_sizes(events(spark, d), 3)))
query("factor_join", f"WITH {_EV}, {_FAC} SELECT {_id('event_id')}, {_r('add_fac', 'add_fac')}, {_r('mul_fac', 'mul_fac')} FROM fac")(lambda spark, d: out(full_events(spark, d), "event_id", "add_fac", "mul_fac"))
query("index_round_trip", f"WITH {_VIMG} SELECT {_id('vox', 'i', 'j', 'k')} FROM img WHERE i + 16 * j + 256 * k = vox")(lambda spark, d: (lambda x, s: out(G.with_vox(x, s), "vox", "i", "j", "k"))(*volume(spark, d)))

# --- blur and sparse matrices
_PSF = "bt AS (SELECT r AS row, r + o AS col, CASE o WHEN 0 THEN 0.5e0 WHEN 1 THEN 0.3e0 ELSE 0.2e0 END AS a FROM range(256) x(r), (VALUES (-1), (0), (1)) y(o) WHERE r + o BETWEEN 0 AND 255), ba AS (SELECT r AS row, r + o AS col, CASE o WHEN 0 THEN 0.6e0 WHEN 1 THEN 0.25e0 ELSE 0.15e0 END AS a FROM range(8) x(r), (VALUES (-1), (0), (1)) y(o) WHERE r + o BETWEEN 0 AND 7)"
for _name, _row, _col in (("psf_blur", "row", "col"), ("psf_blur_t", "col", "row")):
    query(_name, f"WITH {_IMG}, {_PSF} SELECT CAST(bt.{_row} + 256 * ba.{_row} AS BIGINT) AS vox, {_r('sum(val * bt.a * ba.a)', 'val')} FROM img JOIN bt ON bt.{_col} = vox % 256 JOIN ba ON ba.{_col} = vox // 256 GROUP BY ALL")(lambda spark, d, t=_name.endswith("_t"): out(P.blur(image(spark, d), S, *psf(spark), t)))
_MX = "mx AS (SELECT CAST(event_id % 40 AS INT) AS row, CAST(user_id % 60 AS INT) AS col, sum(1e0 + event_id % 9) AS val FROM events WHERE event_id % 7 <> 3 AND event_id % 40 <> 11 GROUP BY ALL)"
_X = "1e0 + (id * 31 % 17) / 17e0"


def _x(spark, n):
    return spark.range(n).selectExpr("id", f"{_X} AS val")


query("csr_forward", f"WITH {_MX} SELECT CAST(row AS BIGINT) AS id, {_r('sum(mx.val * x.val)', 'val')} FROM mx JOIN (SELECT id, {_X} AS val FROM range(60) t(id)) x ON col = id GROUP BY row")(lambda spark, d: out(P.product(matrix(spark, d), _x(spark, 60))))
query("csr_back", f"WITH {_MX} SELECT CAST(col AS BIGINT) AS id, {_r('sum(mx.val * x.val)', 'val')} FROM mx JOIN (SELECT id, {_X} AS val FROM range(40) t(id)) x ON row = id GROUP BY col")(lambda spark, d: out(P.product(matrix(spark, d), _x(spark, 40), True)))
query("csr_transpose", f"WITH {_MX} SELECT CAST(col AS BIGINT) AS row, CAST(row AS BIGINT) AS col, val FROM mx")(lambda spark, d: out(P.transpose(matrix(spark, d))))
query("csr_pick_rows", f"WITH {_MX} SELECT r AS row, CAST(col AS BIGINT) AS col, val FROM range(30) t(r) JOIN mx ON row = r * 6 % 20")(lambda spark, d: out(P.pick_rows(matrix(spark, d), spark.range(30).selectExpr("CAST(id AS INT) AS new_row", "CAST(id * 6 % 20 AS INT) AS old_row"))))
query("csr_nonempty_rows", f"WITH {_MX} SELECT dense_rank() OVER (ORDER BY row) - 1 AS nz_row, CAST(row AS BIGINT) AS row, count(*) AS n FROM mx GROUP BY row")(lambda spark, d: out(P.nonempty_rows(matrix(spark, d))))
query("csr_column_counts", f"WITH {_MX} SELECT CAST(col AS BIGINT) AS col, count(*) AS n FROM mx GROUP BY col")(lambda spark, d: out(matrix(spark, d).groupBy("col").agg(F.count("*").alias("n"))))
_QU = "qu AS (SELECT row, col, floor(val / ((SELECT max(val) FROM mx) / 131071)) AS w, (SELECT max(val) FROM mx) / 131071 AS scale FROM mx)"
query("csr_quantise", f"WITH {_MX}, {_QU} SELECT CAST(row AS BIGINT) AS row, CAST(col % 16 AS BIGINT) AS i, CAST(col // 16 % 16 AS BIGINT) AS j, CAST(col // 256 AS BIGINT) AS k, CAST(w AS BIGINT) AS w, {_r('scale', 'scale', 9)} FROM qu")(lambda spark, d: out(P.quantise(matrix(spark, d), S), digits=9))
query("csr_quantised_forward", f"WITH {_MX}, {_QU} SELECT CAST(row AS BIGINT) AS id, {_r('sum(w * scale * x.val)', 'val')} FROM qu JOIN (SELECT id, {_X} AS val FROM range(60) t(id)) x ON col = id GROUP BY row")(lambda spark, d: out(P.quantised_product(P.quantise(matrix(spark, d), S), _x(spark, 60), S)))

# --- penalties
_NB = {size: "nb(di, dj, dk, g) AS (VALUES " + ", ".join(f"({i}, {j}, {k}, {1 / (i * i + j * j + k * k) ** 0.5!r})" for i, j, k in R.offset_list(size)) + ")" for size in (0, 1)}
_PR = "pr AS (SELECT a.vox AS v, b.vox AS u, a.val - b.val AS d, g * a.kappa * b.kappa AS gk FROM img a, nb, img b WHERE b.i = a.i + di AND b.j = a.j + dj AND b.k = a.k + dk)"
_AN = lambda kind: f"SELECT CAST(v AS BIGINT) AS vox, {_r(f'sum(4e0 * ({slope_over_t(kind, 'd', _DELTA)}) * gk)', 't1')}, {_r(f'sum(2e0 * ({slope_over_t(kind, 'd', _DELTA)}) * gk * d)', 't2')} FROM pr GROUP BY v"
_IW = lambda kind: f"iw AS (SELECT v, {slope_over_t(kind, 'sqrt(q)', _DELTA)} AS w FROM (SELECT v, sum(d * d * gk) AS q FROM pr GROUP BY v))"
for _kind in POTENTIALS:
    query(f"mrf_{_kind}", f"WITH {_VIMG}, {_NB[0]}, {_PR} {_AN(_kind)}")(lambda spark, d, k=_kind: out(R.surrogate(*volume(spark, d), k, _DELTA)))
    query(f"potential_{_kind}", f"WITH {_VIMG} SELECT vox, {_r(phi(_kind, 't', _DELTA), 'phi')}, {_r(slope(_kind, 't', _DELTA), 'slope')}, {_r(slope_over_t(_kind, 't', _DELTA), 'ratio')} FROM (SELECT CAST(vox AS BIGINT) AS vox, val - 1.4e0 AS t FROM img)")(
        lambda spark, d, k=_kind: out(volume(spark, d)[0].selectExpr("vox", "val - 1.4e0 AS t").selectExpr("vox", f"{formulas.phi(k, 't', _DELTA)} AS phi", f"{formulas.slope(k, 't', _DELTA)} AS slope", f"{formulas.slope_over_t(k, 't', _DELTA)} AS ratio")))
query("mrf_t1t2_aniso", f"WITH {_VIMG}, {_NB[1]}, {_PR} {_AN('huber')}")(lambda spark, d: out(R.surrogate(*volume(spark, d), "huber", _DELTA, 1)))
_ISO = "SELECT CAST(pr.v AS BIGINT) AS vox, " + _r("sum(2e0 * (a.w + b.w) * gk)", "t1") + ", " + _r("sum((a.w + b.w) * gk * d)", "t2") + " FROM pr JOIN iw a ON a.v = pr.v JOIN iw b ON b.v = pr.u GROUP BY pr.v"
query("mrf_t1t2_iso", f"WITH {_VIMG}, {_NB[1]}, {_PR}, {_IW('hyperbola')} {_ISO}")(lambda spark, d: out(R.surrogate(*volume(spark, d), "hyperbola", _DELTA, 1, True)))
query("mrf_grad_aniso", f"WITH {_VIMG}, {_NB[1]}, {_PR} SELECT CAST(v AS BIGINT) AS vox, {_r(f'sum(2e0 * ({slope('fair', 'd', _DELTA)}) * gk)', 'grad')} FROM pr GROUP BY v")(lambda spark, d: out(R.gradient(*volume(spark, d), "fair", _DELTA, 1)))
query("mrf_grad_iso", f"WITH {_VIMG}, {_NB[1]}, {_PR}, {_IW('hl')} SELECT CAST(pr.v AS BIGINT) AS vox, {_r('sum((a.w + b.w) * gk * d)', 'grad')} FROM pr JOIN iw a ON a.v = pr.v JOIN iw b ON b.v = pr.u GROUP BY pr.v")(lambda spark, d: out(R.gradient(*volume(spark, d), "hl", _DELTA, 1, True)))
_CUBE = "cb(pi, pj, pk) AS (SELECT a, b, c FROM (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b), (VALUES (-1), (0), (1)) z(c))"
_PP = ("pp AS (SELECT v.vox AS v, n.vox AS u, v.kappa * n.kappa AS kk, a.vox AS a, b.vox AS b, coalesce(a.val, 0e0) - coalesce(b.val, 0e0) AS d, CAST(a.vox IS NOT NULL AS INT) + CAST(b.vox IS NOT NULL AS INT) AS c "
       "FROM img v CROSS JOIN nb JOIN img n ON n.i = v.i + di AND n.j = v.j + dj AND n.k = v.k + dk CROSS JOIN cb LEFT JOIN img a ON a.i = v.i + pi AND a.j = v.j + pj AND a.k = v.k + pk LEFT JOIN img b ON b.i = n.i + pi AND b.j = n.j + pj AND b.k = n.k + pk)")  # fmt: skip
_PT = "SELECT CAST(x AS BIGINT) AS vox, {t1}{t2} FROM (SELECT a AS x, d * w * kk AS s, c * w * kk AS t FROM pw UNION ALL SELECT b, -d * w * kk, c * w * kk FROM pw) WHERE x IS NOT NULL GROUP BY x"
_PA = f"pw AS (SELECT *, {slope_over_t('hyperbola', 'sqrt(sum(d * d) OVER (PARTITION BY v, u))', _DELTA)} AS w FROM pp)"
_PI = f"pw AS (SELECT *, {slope_over_t('hyperbola', 'sqrt(sum(d * d * kk) OVER (PARTITION BY v))', _DELTA)} AS w FROM pp)"
_T1, _T2 = _r("sum(t)", "t1") + ", ", _r("sum(s)", "t2")
query("patch_t1t2_aniso", f"WITH {_VIMG}, {_NB[0]}, {_CUBE}, {_PP}, {_PA} {_PT.format(t1=_T1, t2=_T2)}")(lambda spark, d: out(R.patch_surrogate(*volume(spark, d), "hyperbola", _DELTA)))
query("patch_t1t2_iso", f"WITH {_VIMG}, {_NB[0]}, {_CUBE}, {_PP}, {_PI} {_PT.format(t1=_T1, t2=_T2)}")(lambda spark, d: out(R.patch_surrogate(*volume(spark, d), "hyperbola", _DELTA, 0, True)))
query("patch_grad", f"WITH {_VIMG}, {_NB[0]}, {_CUBE}, {_PP}, {_PA} {_PT.format(t1='', t2=_r('sum(s)', 'grad'))}")(lambda spark, d: out(R.patch_gradient(*volume(spark, d), "hyperbola", _DELTA)))
query("mean_t1t2", f"WITH {_VIMG} SELECT CAST(vox AS BIGINT) AS vox, 1e0 AS t1, {_r('val - kappa', 't2')} FROM img")(lambda spark, d: out(R.mean_surrogate(volume(spark, d)[0], volume(spark, d)[0].selectExpr("vox", "kappa AS val"))))
query("fov_mask", f"WITH {_img('max(2)', 64)} SELECT CAST(vox AS BIGINT) AS vox, CASE WHEN pow(i + 1 - 32.5e0, 2) + pow(j + 1 - 32.5e0, 2) > 1764 THEN 0e0 ELSE {_r('val', 'x').removesuffix(' AS x')} END AS val FROM img")(lambda spark, d: out(R.fov_mask(image(spark, d, WIDE), WIDE), "vox", "val"))

# --- patch matching
_M, _K = N.Matching(), 4
_DS = lambda centres: (f"{_CUBE}, wd AS (SELECT v.vox AS v, n.vox AS u, coalesce(a.val, 0e0) - coalesce(b.val, 0e0) AS d FROM (SELECT * FROM img {centres}) v CROSS JOIN cb o JOIN img n ON n.i = v.i + o.pi AND n.j = v.j + o.pj AND n.k = v.k + o.pk CROSS JOIN cb "  # noqa: E731
       "LEFT JOIN img a ON a.i = v.i + cb.pi AND a.j = v.j + cb.pj AND a.k = v.k + cb.pk LEFT JOIN img b ON b.i = n.i + cb.pi AND b.j = n.j + cb.pj AND b.k = n.k + cb.pk), ds AS (SELECT v, u, sum(d * d) AS d FROM wd GROUP BY v, u)")  # fmt: skip
_BL = "WHERE i % 2 = 0 AND j % 2 = 0 AND k % 2 = 0"
_KN = f"{_DS(_BL)}, kn AS (SELECT * FROM (SELECT v, u, round(d, 9) AS d, row_number() OVER (PARTITION BY v ORDER BY round(d, 9), u) AS rank FROM ds) WHERE rank <= {_K})"
_FL = "cv AS (SELECT n.vox, count(*) AS n FROM img v CROSS JOIN cb JOIN img n ON n.i = v.i + pi AND n.j = v.j + pj AND n.k = v.k + pk WHERE v.i % 2 = 0 AND v.j % 2 = 0 AND v.k % 2 = 0 GROUP BY n.vox), ce AS (SELECT a.vox AS a, b.vox AS b FROM kn JOIN img x ON x.vox = kn.v JOIN img y ON y.vox = kn.u CROSS JOIN cb JOIN img a ON a.i = x.i + pi AND a.j = x.j + pj AND a.k = x.k + pk JOIN img b ON b.i = y.i + pi AND b.j = y.j + pj AND b.k = y.k + pk)"
query("nlm_kernel_weights", f"WITH {_VIMG}, {_DS('')} SELECT CAST(v AS BIGINT) AS vox, CAST(u AS BIGINT) AS nbr, {_r('exp(-d / 2e0)', 'w', 6)} FROM ds")(lambda spark, d: out(N.kernel_weights(*volume(spark, d), _M, 2.0), digits=6))
query("patch_knn", f"WITH {_VIMG}, {_KN} SELECT CAST(v AS BIGINT) AS vox, rank, CAST(u AS BIGINT) AS nbr, {_r('d', 'd')} FROM kn")(lambda spark, d: out(N.nearest(*volume(spark, d), _M, _K)))
query("patch_coverage", f"WITH {_VIMG}, {_KN}, {_FL} SELECT CAST(vox AS BIGINT) AS vox, n FROM cv")(lambda spark, d: out(N.coverage(*volume(spark, d), _M)))
query("knn_filter_forward", f"WITH {_VIMG}, {_KN}, {_FL} SELECT CAST(img.vox AS BIGINT) AS vox, {_r('CASE WHEN n > 0 THEN coalesce(t, 0e0) / n END', 'val', 7)} FROM img LEFT JOIN cv USING (vox) LEFT JOIN (SELECT a, sum(val / {_K}) AS t FROM ce JOIN img ON vox = b GROUP BY a) s ON s.a = img.vox")(
    lambda spark, d: (lambda x, s: out(N.filter_forward(x, N.nearest(x, s, _M, _K), s, _M, _K), digits=7))(*volume(spark, d)))
query("knn_filter_backward", f"WITH {_VIMG}, {_KN}, {_FL} SELECT CAST(img.vox AS BIGINT) AS vox, {_r('coalesce(t, 0e0)', 'val', 7)} FROM img LEFT JOIN (SELECT b, sum(val / n / {_K}) AS t FROM ce JOIN img ON img.vox = a JOIN cv ON cv.vox = a GROUP BY b) s ON s.b = img.vox")(
    lambda spark, d: (lambda x, s: out(N.filter_backward(x, N.nearest(x, s, _M, _K), s, _M, _K), digits=7))(*volume(spark, d)))

# --- reconstruction
_SENS = "sn AS MATERIALIZED (SELECT vox, sum(len) AS s FROM seg GROUP BY vox)"
_ONE = f"x0 AS (SELECT CAST(id AS INT) AS vox, 1e0 AS val FROM range({S.voxels}) t(id))"
_START = f"WITH {_LN}, {_IMG}, {_FAC}, {_seg()}, {_SENS}, "


def _em(x: str, new: str, subsets: int = 1, m: int = 0) -> str:
    """z<new> and <new>: an update of image x by subset m."""
    at = f"WHERE event_id % {subsets} = {m}"
    return (f"q{new} AS MATERIALIZED (SELECT event_id, coalesce(y, 0e0) + add_fac AS e, mul_fac FROM fac LEFT JOIN (SELECT event_id, sum(val * len) AS y FROM seg JOIN {x} USING (vox) GROUP BY event_id) USING (event_id) {at}), "
            f"z{new} AS (SELECT vox, sum(len * CASE WHEN e > 0 THEN mul_fac / e ELSE 0e0 END) AS z FROM seg JOIN q{new} USING (event_id) GROUP BY vox), "
            f"{new} AS MATERIALIZED (SELECT x.vox, CASE WHEN s > 0 THEN x.val * coalesce(z, 0e0) / (s / {subsets}) ELSE 0e0 END AS val FROM {x} x LEFT JOIN z{new} USING (vox) LEFT JOIN sn USING (vox))")  # fmt: skip


_OUT = "SELECT CAST(vox AS BIGINT) AS vox, " + _r("val", "val") + " FROM "
query("em_update", f"{_START}{_ONE}, {_em('x0', 'xn')} {_OUT}xn")(lambda spark, d: (lambda p: out(recon.em_step(p, recon.ones(p))))(problem(spark, d)))
query("osem_2x2", f"{_START}{_ONE}, {_em('x0', 'x1', 2, 0)}, {_em('x1', 'x2', 2, 1)}, {_em('x2', 'x3', 2, 0)}, {_em('x3', 'x4', 2, 1)} {_OUT}x4")(lambda spark, d: (lambda p: out(recon.em(p, recon.ones(p), 2)))(problem(spark, d, subsets=2)))
_IM = "x0 AS (SELECT vox, val FROM img)"
query("loglik", f"{_START}{_IM}, {_em('x0', 'xn')} SELECT {_r('l1', 'l1', 2)}, {_r('l2', 'l2', 2)}, {_r('l2 - l1', 'll', 2)} FROM (SELECT (SELECT sum(val * s) FROM x0 JOIN sn USING (vox)) AS l1, (SELECT sum(ln(e + 1e-20)) FROM qxn) AS l2)")(
    lambda spark, d: (lambda p: out(p.likelihood(image(spark, d).select("vox", "val"), recon.log_sum(p.ratios(image(spark, d).select("vox", "val"), 0))), digits=2))(problem(spark, d)))
_FLAT = "im AS (SELECT vox, i, j, k, val, 1e0 AS kappa FROM img)"
_PEN = f"{_NB[0]}, pq AS (SELECT a.vox AS v, a.val - b.val AS d FROM im a, nb, im b WHERE b.i = a.i + di AND b.j = a.j + dj AND b.k = a.k + dk), tt AS (SELECT v AS vox, sum(4e0 * 2) AS t1, sum(2e0 * 2 * d) AS t2 FROM pq GROUP BY v)"
query("map_em_update", f"{_START}{_IM}, {_em('x0', 'xn')}, {_FLAT}, {_PEN}, ab AS (SELECT vox, {_BETA} * t1 AS a, coalesce(s, 0e0) - {_BETA} * (t1 * x0.val - t2) AS b, x0.val * coalesce(z, 0e0) AS c FROM x0 JOIN tt USING (vox) LEFT JOIN sn USING (vox) LEFT JOIN zxn USING (vox)) SELECT CAST(vox AS BIGINT) AS vox, {_r('CASE WHEN b + sqrt(b * b + 4 * a * c) > 0 THEN 2 * c / (b + sqrt(b * b + 4 * a * c)) ELSE 0e0 END', 'val')} FROM ab")(
    lambda spark, d: (lambda p: out(recon.em_step(p, image(spark, d).select("vox", "val"))))(problem(spark, d, beta=_BETA, penalty=recon.mrf(S))))
_KM = f"km AS (SELECT r AS row, r + o AS col, CASE o WHEN 0 THEN 0.6e0 ELSE 0.2e0 END AS a FROM range({S.voxels}) x(r), (VALUES (-1), (0), (1)) y(o) WHERE r + o BETWEEN 0 AND {S.voxels - 1})"
query("kem_update", f"{_START}{_ONE}, {_em('x0', 'xn')}, {_KM}, al AS (SELECT x0.vox, CASE WHEN s > 0 THEN coalesce(t, 0e0) / s ELSE 0e0 END AS val FROM x0 LEFT JOIN (SELECT row AS vox, sum(a * z) AS t FROM km JOIN zxn ON col = vox GROUP BY row) k USING (vox) LEFT JOIN sn USING (vox)) SELECT CAST(row AS BIGINT) AS vox, {_r('sum(a * val)', 'val')} FROM km JOIN al ON col = vox GROUP BY row")(
    lambda spark, d: (lambda p: out(recon.kem(p, kernel(spark), recon.ones(p), 1)))(problem(spark, d)))


def _admm(inner: int, beta: float) -> str:
    parts = ["u0 AS (SELECT vox, i, j, k, val FROM img)"]
    for n in range(inner):
        parts.append(f"w{n} AS (SELECT a.vox, 8e0 * count(*) AS t1, 4e0 * sum(a.val - b.val) AS t2 FROM u{n} a, nb, u{n} b WHERE b.i = a.i + di AND b.j = a.j + dj AND b.k = a.k + dk GROUP BY a.vox)")
        parts.append(f"u{n + 1} AS MATERIALIZED (SELECT u.vox, i, j, k, ({2 * beta}e0 * x0.val + {beta}e0 * (t1 * u.val - t2)) / ({2 * beta}e0 + {beta}e0 * t1) AS val FROM u{n} u JOIN x0 USING (vox) JOIN w{n} USING (vox))")
    return ", ".join(parts)


query("admm_step", f"{_START}{_IM}, {_em('x0', 'xn')}, {_NB[0]}, {_admm(2, 0.5)}, ab AS (SELECT vox, coalesce(s, 0e0) - 0.5e0 * u2.val AS b, x0.val * coalesce(z, 0e0) AS c FROM x0 JOIN u2 USING (vox) LEFT JOIN sn USING (vox) LEFT JOIN zxn USING (vox)) SELECT CAST(vox AS BIGINT) AS vox, {_r('CASE WHEN b + sqrt(b * b + 2 * c) > 0 THEN 2 * c / (b + sqrt(b * b + 2 * c)) ELSE 0e0 END', 'val')} FROM ab")(
    lambda spark, d: (lambda p: out(recon.admm(p, image(spark, d).select("vox", "val"), 1, recon.mrf(S), 0.5, 2)))(problem(spark, d)))
_LINES = "[" + ", ".join(f"'{t}'" for t in _CONFIG) + "]"
_CL = (f"c0 AS (SELECT event_id AS line, {_LINES}[event_id % {len(_CONFIG)} + 1] || CASE WHEN user_id % 3 = 0 THEN ' # ' || user_id ELSE '' END AS text FROM events), c1 AS (SELECT *, regexp_replace(split_part(text, '#', 1), '[ \\t\\r\\n\\x08]', '', 'g') AS bare FROM c0), c2 AS (SELECT *, string_split(bare, '=') AS p FROM c1), "
       f"c3 AS (SELECT *, CASE WHEN ltrim(text) LIKE '#%' THEN 'COMMENT' WHEN bare = '' THEN 'EMPTY' WHEN len(p) <> 2 OR p[1] = '' OR p[2] = '' THEN 'BAD' WHEN p[1] NOT IN ({', '.join(repr(k) for k in config.KEYS)}) THEN 'UNKNOWN' ELSE 'OK' END AS state FROM c2)")  # fmt: skip
query("config_validate", f"WITH {_CL} SELECT CAST(line AS BIGINT) AS line, state, CASE WHEN state IN ('OK', 'UNKNOWN') THEN p[1] END AS key, CASE WHEN state IN ('OK', 'UNKNOWN') THEN p[2] END AS value FROM c3")(lambda spark, d: out(config.classify(_config(spark, d)), "line", "state", "key", "value"))
query("config_problems", f"WITH {_CL} SELECT 'duplicate' AS kind, p[1] AS key FROM c3 WHERE state = 'OK' GROUP BY p[1] HAVING count(*) > 1 UNION ALL SELECT 'missing', k FROM (VALUES {', '.join(f'({k!r})' for k in config.MANDATORY)}) t(k) WHERE k NOT IN (SELECT p[1] FROM c3 WHERE state = 'OK')")(lambda spark, d: config.problems(config.classify(_config(spark, d))))


def _config(spark: SparkSession, d: str) -> DataFrame:
    """A line of settings for each event, some with a remark."""
    rows = spark.read.parquet(f"{d}/events.parquet")
    items = ", ".join(f"'{t}'" for t in _CONFIG)
    return rows.selectExpr("event_id AS line", f"concat(get(array({items}), CAST(event_id % {len(_CONFIG)} AS INT)), CASE WHEN user_id % 3 = 0 THEN concat(' # ', user_id) ELSE '' END) AS text")


assert LUT_SIZE == len(S.lut())

from . import run_queries  # noqa: E402, F401; registers queries of files and whole runs
