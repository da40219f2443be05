"""Images in tiles: for those of any size, with no image on the driver or in one task.

A tile is a block of edge x edge x edge voxels (less at the volume's ends). Packed, a tile is one row with its values as an array of doubles, so an image has few rows, and
partial sums are added array by array.

Rays are dealt by tile: each goes to the tiles that it passes, and takes its steps there within the tile's window. What a tile gets may be most of all rays, so the tiles are cut into parts
of RAYS rays or so; a part meets a copy of its tile. Forward, the parts' sums are merged for each event; back, a part gives one array, and the arrays of a tile are added in a tree.

Stencils get each tile with a border of the voxels around it: every voxel is sent to its own tile, and to those near it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scanner import Scanner
from ..plans.store import Scratch
from . import trace

#: Voxels along a tile's edge, rays of a part, and arrays that are added at once.
EDGE, RAYS, FAN = 64, 200_000, 16
PACKED = "tile int, val binary, met binary"


@dataclass(frozen=True)
class Tiles:
    s: Scanner
    edge: int = EDGE

    @property
    def counts(self) -> tuple[int, int, int]:
        return tuple(-(-x // self.edge) for x in (self.s.n, self.s.n, self.s.nk))

    @property
    def number(self) -> int:
        a, b, c = self.counts
        return a * b * c

    def window(self, tile: int, halo: int = 0) -> trace.Window:
        """First and last but one i, j and k; with a halo they may lie outside the volume."""
        a, b, _ = self.counts
        out = []
        for at, n in zip((tile % a, tile // a % b, tile // (a * b)), (self.s.n, self.s.n, self.s.nk), strict=True):
            out += [at * self.edge - halo, min((at + 1) * self.edge, n) + halo]
        return tuple(out)

    def shape(self, tile: int) -> tuple[int, int, int]:
        """Along k, j and i, as arrays are indexed."""
        i0, i1, j0, j1, k0, k1 = self.window(tile)
        return k1 - k0, j1 - j0, i1 - i0

    def voxels(self, tile: int) -> np.ndarray:
        """The numbers of a tile's voxels, in their order in it."""
        i0, i1, j0, j1, k0, k1 = self.window(tile)
        n = self.s.n
        return (np.arange(i0, i1) + n * np.arange(j0, j1)[:, None] + n * n * np.arange(k0, k1)[:, None, None]).ravel()

    def places(self, vox: np.ndarray, window: trace.Window) -> np.ndarray:
        """Where voxels are in a window's array."""
        i0, i1, j0, j1, k0, _ = window
        n = self.s.n
        return (vox % n - i0) + (i1 - i0) * (vox // n % n - j0 + (j1 - j0) * (vox // (n * n) - k0))

    def near(self, halo: int) -> str:
        """An SQL array of the tiles that have voxel vox in them, or within their halo."""
        n, (a, b, _) = self.s.n, self.counts
        span = []
        for at, count in zip((f"CAST(vox % {n} AS INT)", f"CAST(vox div {n} % {n} AS INT)", f"CAST(vox div {n * n} AS INT)"), self.counts, strict=True):
            low, high = f"CAST(greatest({at} - {halo}, 0) div {self.edge} AS INT)", f"CAST(least(({at} + {halo}) div {self.edge}, {count - 1}) AS INT)"
            span.append(f"sequence({low}, {high})" if halo else f"array({low})")
        return f"flatten(transform({span[2]}, z -> flatten(transform({span[1]}, y -> transform({span[0]}, x -> x + {a} * y + {a * b} * z)))))"


def _empty(schema: pa.Schema) -> pa.Table:
    return schema.empty_table()


_PACKED = pa.schema([("tile", pa.int32()), ("val", pa.binary()), ("met", pa.binary())])


def _row(tile: int, val: np.ndarray, met: np.ndarray) -> pa.Table:
    return pa.table([pa.array([tile], pa.int32()), pa.array([val.tobytes()], pa.binary()), pa.array([np.packbits(met).tobytes()], pa.binary())], schema=_PACKED)


def _values(row: dict, size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["val"]), np.unpackbits(np.frombuffer(row["met"], np.uint8), count=size).astype(bool)


def pack(image: DataFrame, t: Tiles) -> DataFrame:
    """tile, val and met of an image (vox and val): the doubles of each tile that has a row, 0 where there is none, and as bits where there are rows."""

    def run(key, rows):
        tile = key[0].as_py()
        size, at = int(np.prod(t.shape(tile))), t.places(rows.column("vox").to_numpy(), t.window(tile))
        val, met = np.zeros(size), np.zeros(size, bool)
        val[at], met[at] = rows.column("val").combine_chunks().fill_null(0).to_numpy(zero_copy_only=False), True
        return _row(tile, val, met)

    rows = image.select(F.col("vox").cast("int").alias("vox"), F.col("val").cast("double").alias("val"))
    return rows.selectExpr(f"get({t.near(0)}, 0) AS tile", "vox", "val").groupBy("tile").applyInArrow(run, PACKED)


def unpack(packed: DataFrame, t: Tiles) -> DataFrame:
    """vox and val."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                vox = t.voxels(row["tile"])
                val, met = _values(row, len(vox))
                yield pa.RecordBatch.from_arrays([pa.array(vox[met].astype(np.int32)), pa.array(val[met])], ["vox", "val"])

    return packed.select("tile", "val", "met").mapInArrow(run, "vox int, val double")


@dataclass
class Dealt:
    """Rays by tile, written: part (own: its number within the tile), tile, event_id, the rays' columns and what else was kept; parts: part and tile; the most parts that a tile has."""

    rays: DataFrame
    parts: DataFrame
    most: int
    t: Tiles
    tracer: str


def _met(part: pa.RecordBatch, rays: trace.Rays, t: Tiles, tracer: str, lut: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lanes, tiles) of the tiles that rays pass, maybe with repetitions."""
    s, e, (a, b, c) = t.s, t.edge, t.counts
    if not tracer.endswith("bresenham"):
        t0, t1 = rays.within(3)
        coarse = [(p, d, v * e, low, 0, count, by) for (p, d, v, low, _, _), count, by in zip(rays.axes(), (b, a, c), (a, 1, a * b), strict=True)]
        for lanes, tile, length in trace.march(t0, t1, coarse):
            some = np.flatnonzero(length > 0)
            yield lanes[some], tile[some].astype(np.int64)
        return
    n = s.n
    for lanes, vox, _ in trace.steps(rays, tracer, lut):
        yield lanes, (vox % n // e + a * (vox // n % n // e) + a * b * (vox // (n * n) // e)).astype(np.int64)


def deal(lines: DataFrame, t: Tiles, store: Scratch, tracer: str = "siddon", keep: tuple[str, ...] = ()) -> Dealt:
    """Sends each line to the tiles that its ray passes. The counts of the tiles, a row each, decide into how many parts each is cut."""
    lut, names = trace.table(t.s, tracer), ["event_id", *trace.columns(tracer), *(f"k_{i}" for i in range(len(keep)))]
    rows = lines.select(F.col("event_id").cast("long").alias("event_id"), *trace.columns(tracer), *(F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)))

    def run(batches):
        for batch in batches:
            for part, rays in trace.cut(batch, t.s, tracer):
                got = [lane * t.number + tile for lane, tile in _met(part, rays, t, tracer, lut)]
                key = np.unique(np.concatenate(got)) if got else np.zeros(0, np.int64)
                if len(key):
                    at = pa.array(key // t.number)
                    yield pa.RecordBatch.from_arrays([pa.array((key % t.number).astype(np.int32)), *(part.column(c).take(at) for c in names)], ["tile", *names])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    table = store(rows.mapInArrow(run, f"tile int, {kinds}"))
    base, first = [], 0
    for r in table.groupBy("tile").count().orderBy("tile").collect():  # a row a tile
        base.append((r["tile"], first, -(-r["count"] // RAYS)))
        first += base[-1][2]
    spark = lines.sparkSession
    of = spark.createDataFrame(base, "tile int, first int, parts int")
    rays = table.join(F.broadcast(of), "tile").selectExpr("CAST(pmod(xxhash64(event_id), parts) AS INT) AS own", "first", "tile", *names).selectExpr("first + own AS part", "own", "tile", *names)
    rays = rays.withColumnsRenamed({f"k_{i}": c for i, c in enumerate(keep)})
    return Dealt(rays, of.selectExpr("tile", "explode(sequence(first, first + parts - 1)) AS part"), max((x[2] for x in base), default=1), t, tracer)


def forward(dealt: Dealt, image: DataFrame) -> DataFrame:
    """event_id and y: the line integrals through an image (vox and val, or packed) of the events whose rays pass its tiles."""
    t, tracer = dealt.t, dealt.tracer
    lut, schema = trace.table(t.s, tracer), pa.schema([("event_id", pa.int64()), ("y", pa.float64())])

    def run(rays, tile):
        if not tile.num_rows or not rays.num_rows:
            return _empty(schema)
        number = tile.column("tile")[0].as_py()
        val, out = np.frombuffer(tile.column("val")[0].as_py()), []
        for batch in rays.combine_chunks().to_batches():
            for part, r in trace.cut(batch, t.s, tracer):
                out.append(pa.RecordBatch.from_arrays([part.column("event_id"), pa.array(trace.integrals(r, val, tracer, lut, t.window(number)))], schema=schema))
        return pa.Table.from_batches(out, schema)

    # a row a part, each with its tile's array; the parts' number is that of all rays by RAYS, and that of tiles
    packed = (image if "tile" in image.columns else pack(image, t)).join(F.broadcast(dealt.parts), "tile").select("part", "tile", "val")
    rays = dealt.rays.select("part", "event_id", *trace.columns(tracer))
    return rays.groupBy("part").cogroup(packed.groupBy("part")).applyInArrow(run, "event_id long, y double").groupBy("event_id").agg(F.sum("y").alias("y"))


def back(dealt: Dealt, weight: str, power: int = 1) -> DataFrame:
    """Packed sums over rays of length (to the power) times a kept column of theirs, one array a tile."""
    t, tracer = dealt.t, dealt.tracer
    lut = trace.table(t.s, tracer)
    schema = pa.schema([pa.field("own", pa.int32()), *_PACKED])

    def run(rays):
        tile = rays.column("tile")[0].as_py()
        own, window = trace.Sums(int(np.prod(t.shape(tile)))), t.window(tile)
        for batch in rays.combine_chunks().to_batches():
            for part, r in trace.cut(batch, t.s, tracer):
                w = part.column("_w").to_numpy(zero_copy_only=False)
                for lanes, vox, length in trace.steps(r, tracer, lut, window):
                    own.add(vox, length**power * w[lanes] if power != 1 else length * w[lanes])
        return _row(tile, own.total, own.met).add_column(0, "own", rays.column("own").slice(0, 1)).cast(schema)

    rays = dealt.rays.select("part", "own", "tile", F.col(weight).cast("double").alias("_w"), *trace.columns(tracer)).where(F.abs("_w") >= trace.TINY_WEIGHT)
    return added(rays.groupBy("part").applyInArrow(run, f"own int, {PACKED}"), dealt.most, t)


def added(parts: DataFrame, most: int, t: Tiles) -> DataFrame:
    """Packed arrays (own, tile, val and met) added by tile, FAN of them in a group, level by level. own counts a tile's arrays from 0, up to `most` of them."""
    schema = pa.schema([pa.field("own", pa.int32()), *_PACKED])

    def run(key, rows):
        tile = key[0].as_py()
        size = int(np.prod(t.shape(tile)))
        total, met = np.zeros(size), np.zeros(size, bool)
        for batch in rows.to_batches():
            for row in batch.to_pylist():
                val, some = _values(row, size)
                total += val
                met |= some
        return _row(tile, total, met).add_column(0, "own", pa.array([key[1].as_py()], pa.int32())).cast(schema)

    while most > 1:
        parts = parts.withColumn("own", F.expr(f"CAST(own div {FAN} AS INT)")).groupBy("tile", "own").applyInArrow(run, f"own int, {PACKED}")
        most = -(-most // FAN)
    return parts.select("tile", "val", "met")


class Block:
    """A tile with halo voxels around it. Arrays are indexed k, j, i; beyond the volume all is 0."""

    def __init__(self, rows: pa.Table, t: Tiles, tile: int, halo: int):
        s, self.tile, self.t = t.s, tile, t
        i0, i1, j0, j1, k0, k1 = window = t.window(tile, halo)
        shape = (k1 - k0, j1 - j0, i1 - i0)
        self.shape, self.start = t.shape(tile), (i0 + halo, j0 + halo, k0 + halo)
        self.kept = tuple(slice(halo, halo + x) for x in self.shape)
        inside = [((np.arange(a, b) >= 0) & (np.arange(a, b) < n)).astype(float) for a, b, n in ((k0, k1, s.nk), (j0, j1, s.n), (i0, i1, s.n))]
        self.inside = inside[0][:, None, None] * inside[1][:, None] * inside[2]
        vox = rows.column("vox").combine_chunks()
        some = vox.is_valid()
        at = t.places(vox.filter(some).to_numpy(), window)
        self.values, self.kappa = np.zeros(shape), self.inside
        self.values.flat[at] = rows.column("val").combine_chunks().filter(some).fill_null(0).to_numpy(zero_copy_only=False)
        if "kappa" in rows.column_names:
            self.kappa = np.zeros(shape)
            self.kappa.flat[at] = rows.column("kappa").combine_chunks().filter(some).fill_null(0).to_numpy(zero_copy_only=False)

    def voxels(self) -> np.ndarray:
        return self.t.voxels(self.tile)


def over_tiles(image: DataFrame, t: Tiles, halo: int, schema: str, make: Callable[[Block], list]) -> DataFrame:
    """make gets each tile with its halo, and gives columns of the schema. image: vox, val and maybe kappa; voxels without a row are 0, and each tile is met even if all of its are."""
    spark, names = image.sparkSession, [c.split()[0] for c in schema.split(", ")]
    columns = ["val", "kappa"] if "kappa" in image.columns else ["val"]
    rows = image.select(F.col("vox").cast("int").alias("vox"), *(F.col(c).cast("double").alias(c) for c in columns)).selectExpr(f"explode({t.near(halo)}) AS tile", "vox", *columns)
    rows = rows.unionByName(spark.range(t.number).selectExpr("CAST(id AS INT) AS tile", "CAST(NULL AS INT) AS vox", *(f"CAST(NULL AS DOUBLE) AS {c}" for c in columns)))

    def run(key, rows):
        return pa.table([pa.array(c) for c in make(Block(rows, t, key[0].as_py(), halo))], names=names)

    return rows.groupBy("tile").applyInArrow(run, schema)
