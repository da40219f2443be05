"""The system matrix written once and used in every iteration: bucketed by event for back projections, and for forward ones too if the image can be broadcast; by voxel for forward projections of larger images.

Its rows then never move again: a join shuffles the image or the ratios only, and what a bucket gives is summed before its shuffle. traced() doesn't move them at all: events are dealt to the
buckets, and traced there. Worth its space where rays are traced many times over.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scanner import MOST_BROADCAST, Scanner
from ..plans.store import Scratch
from .geometry import lines_of_response
from .project import system_matrix

#: Events of a bucket, and the least buckets.
EVENTS, LEAST = 100_000, 8


@dataclass
class StoredMatrix:
    """by_event and by_voxel: tables of event_id, vox and len in as many buckets, one file a bucket; without by_voxel, images are broadcast."""

    by_event: str
    by_voxel: str | None
    store: Scratch

    def table(self, name: str) -> DataFrame:
        return self.store.spark.table(name)

    def forward(self, image: DataFrame) -> DataFrame:
        """event_id and y, of the events that meet a voxel of the image."""
        values = image.select(F.col("vox").cast("int").alias("vox"), "val")
        met = self.table(self.by_voxel).join(values, "vox") if self.by_voxel else self.table(self.by_event).join(F.broadcast(values), "vox")
        return met.groupBy("event_id").agg(F.sum(F.col("len") * F.col("val")).alias("y"))

    def back(self, weights: DataFrame, weight: str = "w", power: int = 1) -> DataFrame:
        """vox and val: the sum of length (to the power) times the events' weights (event_id and weight)."""
        # a merge of sorted buckets: files of events are small for what they hold, so by their size Spark may broadcast them
        met = self.table(self.by_event).join(weights.select(F.col("event_id").cast("long").alias("event_id"), F.col(weight).cast("double").alias("_w")).hint("merge"), "event_id")
        length = F.pow("len", F.lit(power)) if power != 1 else F.col("len")
        return met.groupBy("vox").agg(F.sum(length * F.col("_w")).alias("val"))

    def drop(self) -> None:
        """Takes the tables out of the catalog; their files go with the scratch folder."""
        for name in filter(None, (self.by_event, self.by_voxel)):
            self.store.spark.sql(f"DROP TABLE IF EXISTS {name}")


def write(segments: DataFrame, store: Scratch, buckets: int) -> StoredMatrix:
    """Writes a system matrix (event_id, vox, len) into the scratch folder, twice."""
    name, rows = f"sysmat_{uuid.uuid4().hex}", segments.select(F.col("event_id").cast("long").alias("event_id"), F.col("vox").cast("int").alias("vox"), "len")
    out = StoredMatrix(f"{name}_by_event", f"{name}_by_voxel", store)
    for table, key in ((out.by_event, "event_id"), (out.by_voxel, "vox")):
        _save(rows.repartition(buckets, key), store, table, key, buckets)
    return out


def _save(rows: DataFrame, store: Scratch, table: str, key: str, buckets: int) -> None:
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", f"{store.folder}/{table}").option("compression", "zstd").saveAsTable(table)


def traced(events: DataFrame, s: Scanner, store: Scratch, tracer: str = "siddon") -> StoredMatrix:
    """Writes the system matrix of events; there are as many buckets as their number asks for, so none grows with it. The matrix by voxel is written only if an image is too large to be broadcast."""
    name, buckets = f"sysmat_{uuid.uuid4().hex}", max(LEAST, -(-events.count() // EVENTS))
    out = StoredMatrix(f"{name}_by_event", f"{name}_by_voxel" if s.voxels > MOST_BROADCAST else None, store)
    dealt = events.withColumn("event_id", F.col("event_id").cast("long")).repartition(buckets, "event_id")
    _save(system_matrix(lines_of_response(dealt, s), s, tracer), store, out.by_event, "event_id", buckets)
    if out.by_voxel:
        _save(out.table(out.by_event).repartition(buckets, "vox"), store, out.by_voxel, "vox", buckets)
    return out


def em(m: StoredMatrix, factors: DataFrame, x: DataFrame, iterations: int) -> DataFrame:
    """EM by the stored matrix over all events (factors: event_id, add_fac and mul_fac) from the image x; voxels that no event meets become 0."""
    factors = m.store(factors.select("event_id", "add_fac", "mul_fac"))
    sens = m.store(m.back(factors.withColumn("one", F.lit(1.0)), "one"))
    for _ in range(iterations):
        y = factors.join(m.forward(x).hint("merge"), "event_id", "left").selectExpr("event_id", "coalesce(y, 0e0) + add_fac AS e", "mul_fac")
        z = m.back(y.selectExpr("event_id", "CASE WHEN e > 0e0 THEN mul_fac / e ELSE 0e0 END AS ratio"), "ratio")
        rows = x.join(z.withColumnRenamed("val", "z"), "vox", "left").join(sens.withColumnRenamed("val", "s"), "vox", "left")
        x = m.store(rows.selectExpr("vox", "CASE WHEN s > 0e0 THEN val * coalesce(z, 0e0) / s ELSE 0e0 END AS val"))
    return x
