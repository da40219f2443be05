"""Forward and back projection. An image that fits an array is sent to the rays; larger ones go in tiles, to which the rays are dealt."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scanner import Scanner
from ..plans.store import scratch
from . import tiles, trace


def with_subset(events: DataFrame, subsets: int) -> DataFrame:
    """Adds subset_id and pos, the place in the subset."""
    kept = [f"`{c}`" for c in events.columns if c not in ("subset_id", "pos")]
    return events.selectExpr(*kept, f"CAST(event_id % {subsets} AS INT) AS subset_id", f"event_id div {subsets} AS pos")


def subset_sizes(events: DataFrame, subsets: int) -> DataFrame:
    return with_subset(events, subsets).groupBy("subset_id").agg(F.count("*").alias("n_events"))


def with_factors(events: DataFrame, add: DataFrame | None = None, mul: DataFrame | None = None) -> DataFrame:
    """Adds add_fac (0 where the table has none) and mul_fac (1), by event_id. Factors may be as many as events, however few bytes their files take, so no join sends them through the driver."""
    for df, name, default in ((add, "add_fac", 0.0), (mul, "mul_fac", 1.0)):
        if df is None:
            events = events.withColumn(name, F.lit(default))
        else:
            events = events.join(df.select("event_id", F.col(name).cast("double").alias(name)).hint("merge"), "event_id", "left").withColumn(name, F.coalesce(name, F.lit(default)))
    return events


def forward(lines: DataFrame, image: DataFrame | Broadcast, s: Scanner, tracer: str = "siddon", keep: tuple[str, ...] = (), edge: int | None = None) -> DataFrame:
    """event_id, y, the image's line integral, and the lines' columns keep; 0 for lines that miss.

    With an image that fits an array, or is sent already (trace.sent), each line sums its own integral and nothing is shuffled. Larger ones, or any if tiles of some edge are asked for, go in tiles: the lines are dealt by
    tile, and their parts' sums are merged for each event.
    """
    if edge is None and trace.fits(s):
        return trace.forward(lines, image, s, tracer, keep)
    dealt = tiles.deal(lines, tiles.Tiles(s, edge or tiles.EDGE), scratch(lines.sparkSession), tracer)
    return merged(lines, tiles.forward(dealt, image), keep)


def merged(lines: DataFrame, sums: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return lines.select("event_id", *keep).join(sums.hint("merge"), "event_id", "left").select("event_id", F.coalesce("y", F.lit(0.0)).alias("y"), *keep)


def back(lines: DataFrame, s: Scanner, weight: str = "w", tracer: str = "siddon", power: int = 1, edge: int | None = None) -> DataFrame:
    """vox and val: the sum over lines of length (to the power) times the line's weight, a column of lines; voxels without any have no row.

    The weight goes along with its line, so there is no join, and lines of no weight are dropped before they are traced. With an image that fits an array, a task
    shuffles one row for each voxel that its lines meet; in tiles, one array for each part of a tile's lines.
    """
    if power == 2 and tracer.startswith("tof"):
        raise ValueError("squared lengths have no time-of-flight form")
    if edge is None and trace.fits(s):
        return trace.back(lines, s, weight, tracer, power)
    t = tiles.Tiles(s, edge or tiles.EDGE)
    rows = lines.withColumn("_w", F.col(weight).cast("double")).where(F.abs("_w") >= trace.TINY_WEIGHT)
    return tiles.unpack(tiles.back(tiles.deal(rows, t, scratch(lines.sparkSession), tracer, ("_w",)), "_w", power), t)


def system_matrix(lines: DataFrame, s: Scanner, tracer: str = "siddon") -> DataFrame:
    """event_id, vox, len: a row of the system matrix for each line and voxel, made in the line's own row; worth writing when it is used again and again."""
    return trace.matrix(lines, s, tracer)


def attenuation(lines: DataFrame, image: DataFrame, s: Scanner) -> DataFrame:
    """event_id and factor, exp(-y)."""
    return forward(lines, image, s).select("event_id", F.exp(-F.col("y")).alias("factor"))


def sensitivity(lines: DataFrame, s: Scanner, edge: int | None = None) -> DataFrame:
    """The back projection of ones."""
    return back(lines.withColumn("_one", F.lit(1.0)), s, "_one", edge=edge)
