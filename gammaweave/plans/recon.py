"""Iterative reconstruction. Each subset's update is one plan over DataFrames; its image is written before the next, so plans stay short.

events: event_id, the four ids, tbin_id, and maybe add_fac and mul_fac. Images: vox and val. Subsets follow each other, as each
needs the image of the one before; within one, everything is distributed. Iterations deal the events into their subsets once, by a write; an update then reads its own
subset, and traces each ray once for both directions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import _num
from ..operators import blocks, tiles, trace
from ..operators.geometry import grid, lines_of_response, with_vox
from ..operators.penalty import mean_surrogate, patch_surrogate, surrogate
from ..operators.project import back, forward, merged, sensitivity, with_factors, with_subset
from ..operators.sparse import blur
from .scanner import Scanner
from .store import Scratch, scratch


@dataclass
class Problem:
    """What a reconstruction needs. sens, if given, is not blurred yet. axial and transaxial: blur matrices or None.

    edge: tiles of so many voxels each way hold the image; without it an image of up to trace.MOST_ARRAY voxels is an array, and a larger one has tiles of tiles.EDGE. Rays are dealt
    by tile once a subset, and then used in each iteration.
    """

    events: DataFrame
    scanner: Scanner
    subsets: int = 1
    tracer: str = "siddon"
    transaxial: DataFrame | None = None
    axial: DataFrame | None = None
    sens: DataFrame | None = None
    beta: float = 0.0
    penalty: Callable[[DataFrame], DataFrame] | None = None
    log: list = field(default_factory=list)
    edge: int | None = None

    def __post_init__(self):
        s = self.scanner
        if not {"add_fac", "mul_fac"} <= {*self.events.columns}:
            self.events = with_factors(self.events)
        self.events = with_subset(self.events, self.subsets)
        if self.sens is None:
            self.sens = sensitivity(self.lines, s, self.edge)
        self.s = self._blur(self.sens, True)
        self._rays: dict[int, tiles.Dealt] = {}
        self._sent: tuple | None = None

    @property
    def arrays(self) -> bool:
        """Whether images are sent to the rays as arrays."""
        return self.edge is None and trace.fits(self.scanner)

    @property
    def lines(self) -> DataFrame:
        return lines_of_response(self.events, self.scanner)

    def dealt(self, store: Scratch) -> None:
        """Writes the events by subset, and the sensitivity, for iterations to read."""
        self.events, self.s, self._rays = store(self.events, "subset_id"), store(self.s), {}

    def _blur(self, image: DataFrame, transposed: bool) -> DataFrame:
        return image if self.transaxial is None and self.axial is None else blur(image, self.scanner, self.transaxial, self.axial, transposed)

    def _lines(self, subset: int | None) -> DataFrame:
        return lines_of_response(self.events if subset is None else self.events.where(F.col("subset_id") == subset), self.scanner)

    def _traced(self, x: DataFrame):
        """What is traced of x: blurred, and as an array sent to the tasks where that is how images go, once for all that is traced of x."""
        if not self.arrays:
            return self._blur(x, False)
        if self._sent is None or self._sent[0] is not x:
            self._sent = x, trace.sent(self._blur(x, False), self.scanner)
        return self._sent[1]

    def project(self, x: DataFrame, subset: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        return forward(self._lines(subset), self._traced(x), self.scanner, self.tracer, keep, self.edge)

    def ratios(self, x: DataFrame, subset: int) -> DataFrame:
        """event_id, y, expected = y + add_fac and ratio = mul_fac / expected where that is positive, else 0."""
        return _ratios(self.project(x, subset, ("add_fac", "mul_fac")))

    def backproject(self, ratios: DataFrame, subset: int) -> DataFrame:
        lines = self._lines(subset).join(ratios.select("event_id", "ratio").hint("merge"), "event_id")
        return self._blur(back(lines, self.scanner, "ratio", self.tracer, edge=self.edge), True)

    def update(self, x: DataFrame, subset: int, store: Scratch) -> tuple[DataFrame, DataFrame]:
        """The back projected ratios (vox, val) of a subset at x, and the sum l2 of log(expected + 1e-20)."""
        if self.arrays:
            done = store(self._pass(x, subset).groupBy("vox").agg(F.sum("val").alias("val")))
            return self._blur(done.where("vox >= 0"), True), done.where("vox < 0").agg(F.coalesce(F.sum("val"), F.lit(0.0)).alias("l2"))
        if subset not in self._rays:
            self._rays[subset] = tiles.deal(self._lines(subset), tiles.Tiles(self.scanner, self.edge or tiles.EDGE), store, self.tracer)
        rays = self._rays[subset]
        sums = merged(self._lines(subset), tiles.forward(rays, self._blur(x, False)), ("add_fac", "mul_fac"))
        r = store(_ratios(sums))
        weighed = replace(rays, rays=rays.rays.join(r.select("event_id", "ratio").hint("merge"), "event_id"))
        return self._blur(store(tiles.unpack(tiles.back(weighed, "ratio"), rays.t)), True), log_sum(r)

    def _pass(self, x: DataFrame, subset: int) -> DataFrame:
        return trace.em_pass(self._lines(subset), self._traced(x), self.scanner, self.tracer)

    def passed(self, x: DataFrame, subset: int, store: Scratch) -> DataFrame:
        """What update() gives, as rows of vox and val that are still to be added by vox, l2 those of vox -1. Without a blur none of it is written: who adds the rows has all of them."""
        if self.arrays and self.transaxial is None and self.axial is None:
            return self._pass(x, subset)
        z, l2 = self.update(x, subset, store)
        return z.select(F.col("vox").cast("int").alias("vox"), "val").union(l2.selectExpr("-1 AS vox", "l2 AS val"))

    def likelihood(self, x: DataFrame, l2: DataFrame) -> DataFrame:
        """l1 = sum of x s, whose terms count as 1e-20 where they aren't finite, l2 as given, and ll = l2 - l1: one row each, which are put side by side."""
        l1 = x.join(self.s.withColumnRenamed("val", "sv"), "vox").selectExpr(f"{_term('val', 'sv')} AS a", "CAST(NULL AS DOUBLE) AS b")
        return _likelihood(l1.unionByName(l2.selectExpr("CAST(NULL AS DOUBLE) AS a", "l2 AS b")))


def _term(x: str, s: str) -> str:
    return f"CASE WHEN isnan({x} * {s}) OR abs({x} * {s}) = double('infinity') THEN 1e-20 ELSE {x} * {s} END"


def _likelihood(terms: DataFrame) -> DataFrame:
    """l1, l2 and ll of the terms a of l1 and b of l2."""
    return terms.agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("l1"), F.coalesce(F.sum("b"), F.lit(0.0)).alias("l2")).selectExpr("l1", "l2", "l2 - l1 AS ll")


def _ratios(sums: DataFrame) -> DataFrame:
    rows = sums.selectExpr("event_id", "y", "y + add_fac AS expected", "mul_fac")
    return rows.selectExpr("event_id", "y", "expected", "CASE WHEN expected > 0e0 THEN mul_fac / expected ELSE 0e0 END AS ratio")


def log_sum(ratios: DataFrame) -> DataFrame:
    """l2 of what ratios() gives: log(expected + 1e-20), 0 where that isn't positive; 1e-20 stands for what isn't finite."""
    x = "CASE WHEN isnan(expected) OR abs(expected) = double('infinity') THEN 1e-20 ELSE expected + 1e-20 END"
    return ratios.selectExpr(f"{x} AS x").selectExpr("CASE WHEN x > 0e0 THEN ln(x) ELSE 0e0 END AS x").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("l2"))


def ones(p: Problem) -> DataFrame:
    return grid(p.events.sparkSession, p.scanner).selectExpr("vox", "1e0 AS val")


def em_step(p: Problem, x: DataFrame, subset: int = 0, z: DataFrame | None = None) -> DataFrame:
    """One (penalised) update of x by a subset, whose back projected ratios are z."""
    z = p.passed(x, subset, scratch(x.sparkSession)) if z is None else z
    return _stepped(p, x, z).where("vox >= 0").select("vox", "val")


def _stepped(p: Problem, x: DataFrame, z: DataFrame) -> DataFrame:
    """vox, val after the update and a, the term of l1 before it (null where s has none), from rows of z that are still to be added; what z has for vox -1 stays, as val.

    Images and sums are put under each other and added by voxel, where joins would send them through the driver.
    """
    none = "CAST(NULL AS DOUBLE)"
    under = x.selectExpr("vox", "val AS x", f"{none} AS z", f"{none} AS s", "1 AS own").union(z.selectExpr("vox", none, "val", none, "0")).union(p.s.selectExpr("vox", none, none, "val", "0"))
    sums = under.groupBy("vox").agg(F.max("x").alias("x"), F.sum("z").alias("z"), F.max("s").alias("s"), F.max("own").alias("own")).where("own = 1 OR vox < 0")
    term = f"CASE WHEN s IS NOT NULL THEN {_term('x', 's')} END AS term"
    step = _step(p, x, sums.selectExpr("vox", "x", "x * coalesce(z, 0e0) AS xem", "coalesce(s, 0e0) AS s", term, "z"))
    return step.selectExpr("vox", "CASE WHEN vox < 0 THEN z ELSE val END AS val", "term AS a")


def _step(p: Problem, x: DataFrame, rows: DataFrame) -> DataFrame:
    """vox, val, term and z from rows of x, xem = x z, s, term and z."""
    kept = ("vox", "term", "z")
    if p.beta > 0 and p.penalty is not None:
        t = p.penalty(with_ijk(x, p))
        rows = rows.join(t, "vox", "left").selectExpr(*kept, f"{_num(p.beta)} * coalesce(t1, 0e0) AS a", f"s - {_num(p.beta)} * (coalesce(t1, 0e0) * x - coalesce(t2, 0e0)) AS b", f"{p.subsets} * xem AS c")
        rows = rows.selectExpr("*", "sqrt(b * b + 4e0 * a * c) AS det")
        return rows.selectExpr(*kept, "CASE WHEN a = 0e0 THEN CASE WHEN b <> 0e0 THEN c / nullif(b, 0e0) ELSE 0e0 END WHEN b + det > 0e0 THEN 2e0 * c / nullif(b + det, 0e0) ELSE 0e0 END AS val")
    return rows.selectExpr(*kept, f"CASE WHEN s > 0e0 THEN xem / nullif(s / {p.subsets}, 0e0) ELSE 0e0 END AS val")


def with_ijk(x: DataFrame, p: Problem) -> DataFrame:
    n = p.scanner.n
    return x.selectExpr("vox", f"CAST(vox % {n} AS INT) AS i", f"CAST(vox div {n} % {n} AS INT) AS j", f"CAST(vox div {n * n} AS INT) AS k", "val")


@dataclass
class Outputs:
    """What iterations give out on their way, each if there is a function for it: image(n, x), alpha(n, x), both each step-th time, and projection(n, subset, rows), whose rows have a name."""

    step: int = 0
    image: Callable[[int, DataFrame], None] | None = None
    alpha: Callable[[int, DataFrame], None] | None = None
    projection: Callable[[int, int, DataFrame], None] | None = None

    def iteration(self, n: int, x: DataFrame, alpha: DataFrame | None = None) -> None:
        if self.step > 0 and n % self.step == 0:
            if self.image:
                self.image(n, x)
            if self.alpha and alpha is not None:
                self.alpha(n, alpha)

    def subset(self, p: Problem, x: DataFrame, n: int, m: int) -> None:
        """Line integrals at x, and those with the background, traced once."""
        if self.projection:
            self.projection(n, m, p.ratios(x, m).selectExpr("event_id", "stack(2, 'Px', y, 'Px_r_s', expected) AS (name, val)"))


def em(p: Problem, x: DataFrame, iterations: int, outputs: Outputs | None = None, phase: str = "main") -> DataFrame:
    """Passes over all subsets; p.log gets (phase, iteration, subset, likelihood frame)."""
    store, outputs = scratch(p.events.sparkSession), outputs or Outputs()
    p.dealt(store)
    for n in range(1, iterations + 1):
        for m in range(p.subsets):
            outputs.subset(p, x, n, m)
            done = store(_stepped(p, x, p.passed(x, m, store)))
            p.log.append((phase, n, m, _likelihood(done.selectExpr("a", "CASE WHEN vox < 0 THEN val END AS b"))))
            x = done.where("vox >= 0").select("vox", "val")
        outputs.iteration(n, x)
    return x


def likelihoods(log: list) -> DataFrame | None:
    """phase, iter, subset, l1, l2 and ll of a problem's log."""
    out = None
    for phase, n, m, frame in log:
        row = frame.selectExpr(f"'{phase}' AS phase", f"{n} AS iter", f"{m} AS subset", "*")
        out = row if out is None else out.union(row)
    return out


def kem(p: Problem, kernel: DataFrame, x: DataFrame, iterations: int, outputs: Outputs | None = None) -> DataFrame:
    """Kernel EM: alpha from 1; x = K alpha. kernel: row, col, val, symmetric; it is written in blocks. The first projection uses x as given."""
    store, outputs = scratch(p.events.sparkSession), outputs or Outputs()
    if kernel.isEmpty():
        raise ValueError("the kernel matrix is missing or empty")
    p.dealt(store)
    matrix, alpha, as_id = blocks.write(kernel, store), ones(p), lambda v: v.select(F.col("vox").alias("id"), "val")
    for n in range(1, iterations + 1):
        for m in range(p.subsets):
            z, l2 = p.update(x, m, store)
            p.log.append(("kernel", n, m, p.likelihood(x, l2)))
            ab = matrix.product(as_id(z)).select(F.col("id").cast("int").alias("vox"), F.col("val").alias("ab"))
            rows = alpha.join(ab, "vox", "left").join(p.s.withColumnRenamed("val", "s"), "vox", "left")
            alpha = store(rows.selectExpr("vox", f"CASE WHEN s > 0e0 THEN val * coalesce(ab, 0e0) / nullif(s / {p.subsets}, 0e0) ELSE 0e0 END AS val"))
            x = store(matrix.product(as_id(alpha)).select(F.col("id").cast("int").alias("vox"), "val"))
        outputs.iteration(n, x, alpha)
    return x


def admm(p: Problem, x: DataFrame, iterations: int, penalty: Callable[[DataFrame], DataFrame], beta: float, inner: int = 10, outputs: Outputs | None = None) -> DataFrame:
    """u follows the penalty by `inner` fixed-point steps, x an EM pass held to u + d, and d gathers what is left; mu is 2 beta."""
    store, mu, outputs = scratch(p.events.sparkSession), 2 * beta, outputs or Outputs()
    u, d, sens = x, x.selectExpr("vox", "0e0 AS val"), store(p.sens)
    join = lambda a, b, e: a.join(b.select("vox", F.col("val").alias("w")), "vox").selectExpr("vox", f"{e} AS val")
    for n in range(1, iterations + 1):
        m = store(join(x, d, "val - w"))
        for _ in range(inner):
            t = penalty(with_ijk(u, p))
            u = store(u.join(m.withColumnRenamed("val", "m"), "vox").join(t, "vox", "left").selectExpr("vox", f"({_num(mu)} * m + {_num(beta)} * (coalesce(t1, 0e0) * val - coalesce(t2, 0e0))) / ({_num(mu)} + {_num(beta)} * coalesce(t1, 0e0)) AS val"))
        target = store(join(u, d, "val + w"))
        held = Problem(p.events, p.scanner, p.subsets, p.tracer, p.transaxial, p.axial, sens, mu / 2, lambda v, t=target: mean_surrogate(v, t), p.log, p.edge)
        x = em(held, x, 1, phase=f"admm {n}")
        d = store(d.join(x.withColumnRenamed("val", "x"), "vox").join(u.withColumnRenamed("val", "u"), "vox").selectExpr("vox", "val - (x - u) AS val"))
        outputs.iteration(n, x)
    return x


def line_integrals(p: Problem, x: DataFrame, exponential: bool = False) -> DataFrame:
    """y (or exp(-y)) of the first subset's events."""
    y = p.project(x, 0)
    return y.select("event_id", F.exp(-F.col("y")).alias("factor")) if exponential else y


def mrf(s: Scanner, kind: str = "quad", delta: float = 1.0, size: int = 0, isotropic: bool = False):
    return lambda x: surrogate(x, s, kind, delta, size, isotropic)


def patch(s: Scanner, kind: str = "quad", delta: float = 1.0, size: int = 0, isotropic: bool = False):
    return lambda x: patch_surrogate(x, s, kind, delta, size, isotropic)


__all__ = ["Outputs", "Problem", "admm", "em", "em_step", "kem", "likelihoods", "line_integrals", "mrf", "ones", "patch", "with_ijk", "with_vox"]
