"""Rays through an image held as one array, in numpy: all rays of a batch take their next step together.

An image of up to MOST_ARRAY voxels is sent to the workers as an array. A ray then needs no join and no row for each voxel: its line integral is summed as it goes, and a
back projection adds to an array of the task's own. Images beyond that go in `tiles`, and there a ray takes the same steps within a tile's window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scanner import LUT_SIZE, Scanner

#: Voxels of an image that is sent as an array, of doubles (32 MB); larger ones go in tiles.
MOST_ARRAY = 1 << 22
#: Rays that step together; after how many steps it is seen which have ended, and how many must be left for the others to stay in the arrays.
BATCH, CHECK, SHARE = 10_000, 8, 0.85
TINY_LENGTH, TINY_WEIGHT = 1e-9, 1e-30
ENDS = ("x0", "y0", "z0", "x1", "y1", "z1")

Step = tuple[np.ndarray, np.ndarray, np.ndarray]
#: First and last but one i, j and k of a part of the image.
Window = tuple[int, int, int, int, int, int]


class Rays:
    """Ends of rays as arrays, cut to the time bin's reach where they have one."""

    def __init__(self, ends: list[np.ndarray], s: Scanner, tbin: np.ndarray | None = None):
        self.s, p, q = s, ends[:3], ends[3:]
        self.unit, self.at = None, None
        if tbin is not None:
            d = [b - a for a, b in zip(p, q, strict=True)]
            with np.errstate(invalid="ignore", divide="ignore"):
                length = np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
                self.unit = [x / length for x in d]
            off = tbin * s.spacing
            mid, reach = [(a + b) / 2 for a, b in zip(p, q, strict=True)], 3 * s.sigma
            p, q = [m + (off - reach) * u for m, u in zip(mid, self.unit, strict=True)], [m + (off + reach) * u for m, u in zip(mid, self.unit, strict=True)]
            self.at = sum(u * (m + off * u) for m, u in zip(mid, self.unit, strict=True))
        self.p, self.d = p, [b - a for a, b in zip(p, q, strict=True)]

    def within(self, axes: int) -> tuple[np.ndarray, np.ndarray]:
        """Entry and exit of the box between the outer voxels' centres, over the first axes; not hit where the first is not smaller."""
        s = self.s
        half = [(s.n / 2 - 0.5) * s.voxel] * 2 + [(s.nk / 2 - 0.5) * s.voxel_k]
        t0, t1 = np.zeros(len(self.p[0])), np.ones(len(self.p[0]))
        for p, d, h in list(zip(self.p, self.d, half, strict=True))[:axes]:
            with np.errstate(invalid="ignore", divide="ignore"):
                one, two = (-h - p) / d, (h - p) / d
            flat, inside = d == 0, (p >= -h) & (p <= h)
            t0 = np.maximum(t0, np.where(flat, np.where(inside, 0, 2), np.minimum(one, two)))
            t1 = np.minimum(t1, np.where(flat, np.where(inside, 1, -1), np.maximum(one, two)))
        return t0, t1

    def shares(self, lanes: np.ndarray, i: np.ndarray, j: np.ndarray, k: np.ndarray, lut: np.ndarray) -> np.ndarray:
        """The share of the time bin's Gaussian at voxels' centres; 0 beyond its reach."""
        s, (x, y, z) = self.s, self.unit
        far = np.abs(x[lanes] * ((j - (s.n / 2 - 0.5)) * s.voxel) + y[lanes] * (((s.n / 2 - 0.5) - i) * s.voxel) + z[lanes] * ((k - (s.nk / 2 - 0.5)) * s.voxel_k) - self.at[lanes])
        bin_ = np.floor(far / s.lut_step).astype(np.int64)
        return np.where(bin_ < LUT_SIZE, lut[np.minimum(bin_, LUT_SIZE - 1)], 0.0)


    def axes(self, window: Window | None = None) -> list[tuple]:
        """Place and direction, size of a voxel, the volume's lower end, and the first voxel and the number of voxels of the window, along j, i and k."""
        s = self.s
        i0, i1, j0, j1, k0, k1 = window or (0, s.n, 0, s.n, 0, s.nk)
        flat, deep = -s.n * s.voxel / 2, -s.nk * s.voxel_k / 2
        return [(self.p[0], self.d[0], s.voxel, flat, j0, j1 - j0), (-self.p[1], -self.d[1], s.voxel, flat, i0, i1 - i0), (self.p[2], self.d[2], s.voxel_k, deep, k0, k1 - k0)]


def walk(rays: Rays, window: Window | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """march() through the image's voxels, or those of a window, which are then counted within it."""
    t0, t1 = rays.within(3)
    axes = rays.axes(window)
    if window:
        for p, d, v, low, first, count in axes:
            with np.errstate(invalid="ignore", divide="ignore"):
                one, two = (low + first * v - p) / d, (low + (first + count) * v - p) / d
            flat, at = d == 0, np.floor((p - low) / v)
            inside = (at >= first) & (at < first + count)
            t0 = np.maximum(t0, np.where(flat, np.where(inside, 0, 2), np.minimum(one, two)))
            t1 = np.minimum(t1, np.where(flat, np.where(inside, 1, -1), np.maximum(one, two)))
    j, i, k = axes
    yield from march(t0, t1, [(*j, i[5]), (*i, 1), (*k, i[5] * j[5])])


def march(t0: np.ndarray, t1: np.ndarray, axes: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(lanes, cells, parts) step by step: the exact parts of each ray in the cells that it passes from t0 to t1, as shares of its length.

    A ray's next crossings with the planes of the three axes follow from where it enters; each step goes to the nearest and into the cell beyond. The arrays are
    the same in each step, to be used before the next. A ray that has ended has parts of 0, in any cell (even none), till it is taken out of the arrays.
    axes: as Rays.axes() gives them, and what a step along each adds to the cell's number.
    """
    lanes = np.flatnonzero(t0 < t1)
    t, end, vox, state = t0[lanes], t1[lanes], np.zeros(len(lanes), np.int32), []
    for p, d, v, low, first, count, by in axes:
        p, d = p[lanes], d[lanes]
        at = np.clip(np.floor((p + t * d - low) / v), first, first + count - 1).astype(np.int32)
        with np.errstate(invalid="ignore", divide="ignore"):
            following = np.where(d == 0, np.inf, ((at + (d > 0)) * v + low - p) / d)
            gap = np.where(d == 0, 0.0, v / np.abs(d))
        state.append([following, gap, np.sign(d).astype(np.int32) * np.int32(by)])
        vox += (at - np.int32(first)) * np.int32(by)
    step = 0
    while len(lanes):
        if step % CHECK == 0:
            live = t < end
            if np.count_nonzero(live) < SHARE * len(lanes):
                lanes, vox, t, end = (x[live] for x in (lanes, vox, t, end))
                state = [[x[live] for x in axis] for axis in state]
                if not len(lanes):
                    return
            nearest, stop, part, f, g, hit = (np.empty(len(lanes), k) for k in (float, float, float, float, np.int32, bool))
        step += 1
        np.minimum(state[0][0], state[1][0], out=nearest)
        np.minimum(nearest, state[2][0], out=nearest)
        np.minimum(nearest, end, out=stop)
        np.subtract(stop, t, out=part)
        t, stop = stop, t
        yield lanes, vox, part
        for following, gap, move in state:
            np.less_equal(following, nearest, out=hit)
            np.multiply(gap, hit, out=f)
            following += f
            np.multiply(move, hit, out=g)
            vox += g


def siddon(rays: Rays, window: Window | None = None) -> Iterator[Step]:
    """(lanes, voxels, lengths) step by step."""
    norm = np.sqrt(sum(d * d for d in rays.d))
    for lanes, vox, part in walk(rays, window):
        length = part * norm[lanes]
        some = np.flatnonzero(length > TINY_LENGTH)
        yield lanes[some], vox[some], length[some]


def samples(rays: Rays, window: Window | None = None) -> Iterator[Step]:
    """(lanes, voxels, lengths): one nearest voxel for each plane of the ray's major axis; the length is the slope's weight."""
    s, n, v = rays.s, rays.s.n, rays.s.voxel
    i0, i1, j0, j1, k0, k1 = window or (0, n, 0, n, 0, s.nk)
    h = n * v / 2
    t0, t1 = rays.within(2)
    for flat in (True, False):
        major, minor = (0, 1) if flat else (1, 0)
        lanes = np.flatnonzero((t0 < t1) & ((np.abs(rays.d[0]) > np.abs(rays.d[1])) == flat))
        p, d = [x[lanes] for x in rays.p], [x[lanes] for x in rays.d]
        ends = [np.floor((p[major] + t[lanes] * d[major] + h) / v).astype(np.int64) for t in (t0, t1)]
        first, last = np.minimum(*ends), np.maximum(*ends)
        if window:
            first, last = np.maximum(first, j0 if flat else n - i1), np.minimum(last, j1 - 1 if flat else n - 1 - i0)
        with np.errstate(invalid="ignore", divide="ignore"):
            weight = np.sqrt(1 + (d[minor] / d[major]) ** 2)
        for step in range(int((last - first).max(initial=-1)) + 1):
            m = first + step
            with np.errstate(invalid="ignore", divide="ignore"):
                t = ((m - (n / 2 - 0.5)) * v - p[major]) / d[major]
                x, y, z = (a + t * b for a, b in zip(p, d, strict=True))
                i, j, k = np.floor((h - y) / v), np.floor((x + h) / v), np.floor((z + s.nk * s.voxel_k / 2) / s.voxel_k)
            i, j = (i, m) if flat else (n - 1 - m, j)
            ok = np.flatnonzero((m <= last) & (i >= i0) & (i < i1) & (j >= j0) & (j < j1) & (k >= k0) & (k < k1))
            yield lanes[ok], (i[ok] - i0 + (i1 - i0) * (j[ok] - j0 + (j1 - j0) * (k[ok] - k0))).astype(np.int64), weight[ok]


def steps(rays: Rays, tracer: str, lut: np.ndarray | None = None, window: Window | None = None) -> Iterator[Step]:
    """tracer: siddon, bresenham, tof or tof_bresenham; the latter two weigh by time of flight."""
    base = samples if tracer.endswith("bresenham") else siddon
    if not tracer.startswith("tof"):
        yield from base(rays, window)
        return
    i0, i1, j0, j1, k0, _ = window or (0, rays.s.n, 0, rays.s.n, 0, rays.s.nk)
    ni, nj = i1 - i0, j1 - j0
    for lanes, vox, length in base(rays, window):
        w = rays.shares(lanes, vox % ni + i0, vox // ni % nj + j0, vox // (ni * nj) + k0, lut)
        some = np.flatnonzero(w)
        yield lanes[some], vox[some], length[some] * w[some]


def table(s: Scanner, tracer: str) -> np.ndarray | None:
    return np.array(s.lut()) if tracer.startswith("tof") else None


def columns(tracer: str) -> list[str]:
    return [*ENDS, "tbin_id"] if tracer.startswith("tof") else list(ENDS)


def cut(batch: pa.RecordBatch, s: Scanner, tracer: str) -> Iterator[tuple[pa.RecordBatch, Rays]]:
    """Parts of a batch of lines and their rays."""
    for a in range(0, batch.num_rows, BATCH):
        part = batch.slice(a, BATCH)
        get = lambda c: part.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        yield part, Rays([get(c).astype(float) for c in ENDS], s, get("tbin_id") if tracer.startswith("tof") else None)


def as_array(image: DataFrame, s: Scanner) -> np.ndarray:
    """The image as one array on the driver; voxels without a row are 0. Its size is that of the grid, which the caller has checked."""
    out = np.zeros(s.voxels)
    t = image.select(F.col("vox").cast("int").alias("vox"), F.col("val").cast("double").alias("val")).toArrow()
    for batch in t.to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
    return out


def sent(image: DataFrame | Broadcast, s: Scanner) -> Broadcast:
    """The image as an array that tasks have; one that was sent already is used again."""
    return image if isinstance(image, Broadcast) else image.sparkSession.sparkContext.broadcast(as_array(image, s))


def fits(s: Scanner) -> bool:
    return s.voxels <= MOST_ARRAY


def integrals(rays: Rays, image: np.ndarray, tracer: str, lut: np.ndarray | None, window: Window | None = None) -> np.ndarray:
    """Of an image, or of the part of it in a window."""
    y = np.zeros(len(rays.p[0]))
    if tracer != "siddon":
        for lanes, vox, length in steps(rays, tracer, lut, window):
            y[lanes] += length * image[vox]  # a lane is once in a step
        return y
    of, own, value = None, np.zeros(0), np.zeros(0, image.dtype)
    for lanes, vox, part in walk(rays, window):
        if lanes is not of:
            if of is not None:
                y[of] += own
            of, own, value = lanes, np.zeros(len(lanes)), np.empty(len(lanes), image.dtype)
        np.take(image, vox, out=value, mode="clip")
        part *= value
        own += part
    if of is not None:
        y[of] += own
    return y * np.sqrt(sum(d * d for d in rays.d))


class Sums:
    """A back projection of a task's own; rows() are the voxels that some ray has met."""

    def __init__(self, voxels: int):
        self.total, self.met = np.zeros(voxels), np.zeros(voxels, bool)

    def add(self, vox: np.ndarray, value: np.ndarray) -> None:
        np.add.at(self.total, vox, value)
        self.met[vox] = True

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = np.flatnonzero(self.met)
        for a in range(0, len(at), 1 << 20):
            yield at[a : a + (1 << 20)].astype(np.int32), self.total[at[a : a + (1 << 20)]]


def forward(lines: DataFrame, image: DataFrame | Broadcast, s: Scanner, tracer: str = "siddon", keep: tuple[str, ...] = ()) -> DataFrame:
    """event_id, y and keep, in the lines' own rows: no shuffle."""
    held, lut = sent(image, s), table(s, tracer)
    rows = lines.select(F.col("event_id").cast("long").alias("event_id"), *columns(tracer), *(F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)))
    kept = [f"k_{i}" for i in range(len(keep))]

    def run(batches):
        for batch in batches:
            for part, rays in cut(batch, s, tracer):
                yield pa.RecordBatch.from_arrays([part.column("event_id"), pa.array(integrals(rays, held.value, tracer, lut)), *(part.column(c) for c in kept)], ["event_id", "y", *kept])

    done = rows.mapInArrow(run, rows.select("event_id", F.lit(None).cast("double").alias("y"), *kept).schema)
    return done.select("event_id", "y", *(F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)))


def back(lines: DataFrame, s: Scanner, weight: str, tracer: str = "siddon", power: int = 1) -> DataFrame:
    """vox and val; one row a voxel and task is shuffled."""
    lut = table(s, tracer)

    def run(batches):
        own = Sums(s.voxels)
        for batch in batches:
            for part, rays in cut(batch, s, tracer):
                w = part.column("_w").to_numpy(zero_copy_only=False)
                for lanes, vox, length in steps(rays, tracer, lut):
                    own.add(vox, length**power * w[lanes] if power != 1 else length * w[lanes])
        for vox, val in own.rows():
            yield pa.RecordBatch.from_arrays([pa.array(vox), pa.array(val)], ["vox", "val"])

    rows = lines.select(F.col(weight).cast("double").alias("_w"), *columns(tracer)).where(F.abs("_w") >= TINY_WEIGHT)
    return rows.mapInArrow(run, "vox int, val double").groupBy("vox").agg(F.sum("val").alias("val"))


def matrix(lines: DataFrame, s: Scanner, tracer: str = "siddon") -> DataFrame:
    """event_id, vox and len: each ray's voxels, summed within its row's batch; no shuffle."""
    lut = table(s, tracer)

    def run(batches):
        for batch in batches:
            for part, rays in cut(batch, s, tracer):
                got = list(steps(rays, tracer, lut))
                if not got:
                    continue
                lane, vox, length = (np.concatenate([x[k] for x in got]) for k in range(3))
                key, inverse = np.unique(lane * s.voxels + vox, return_inverse=True)
                yield pa.RecordBatch.from_arrays([part.column("event_id").take(pa.array(key // s.voxels)), pa.array((key % s.voxels).astype(np.int32)), pa.array(np.bincount(inverse, length, len(key)))], ["event_id", "vox", "len"])

    return lines.select(F.col("event_id").cast("long").alias("event_id"), *columns(tracer)).mapInArrow(run, "event_id long, vox int, len double")


def em_pass(lines: DataFrame, image: DataFrame | Broadcast, s: Scanner, tracer: str = "siddon") -> DataFrame:
    """One pass of a subset's lines (with add_fac and mul_fac): forward, ratio and back while the ray is at hand.

    Rows are (vox, val) of the back projected ratios, one a voxel and task, to be added, and one of vox -1 a task with its part of the sum of log(expected + 1e-20), which is 0 where that isn't positive.
    """
    held, lut = sent(image, s), table(s, tracer)

    def run(batches):
        own, logs = Sums(s.voxels), 0.0
        for batch in batches:
            for part, rays in cut(batch, s, tracer):
                kept = list(steps(rays, tracer, lut))
                y = np.zeros(part.num_rows)
                for lanes, vox, length in kept:
                    y[lanes] += length * held.value[vox]
                get = lambda c: part.column(c).to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
                expected, mul = y + get("add_fac"), get("mul_fac")
                ratio = ratios(expected, mul)
                logs += log_terms(expected).sum()
                for lanes, vox, length in kept:
                    own.add(vox, length * ratio[lanes])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([float(logs)])], ["vox", "val"])
        for vox, val in own.rows():
            yield pa.RecordBatch.from_arrays([pa.array(vox), pa.array(val)], ["vox", "val"])

    return lines.select("add_fac", "mul_fac", *columns(tracer)).mapInArrow(run, "vox int, val double")


def ratios(expected: np.ndarray, mul: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(expected > 0, mul / expected, 0.0)


def log_terms(expected: np.ndarray) -> np.ndarray:
    """Logs of expected + 1e-20: 0 where that isn't positive; where it isn't finite, 1e-20 stands for it."""
    x = np.where(np.isfinite(expected), expected + 1e-20, 1e-20)
    return np.where(x > 0, np.log(np.where(x > 0, x, 1.0)), 0.0)
