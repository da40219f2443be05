"""Back projection of a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.geometry import lines_of_response
from ..operators.project import back
from ..plans.scanner import Scanner

EVENTS = "event_id long, xtal_id_1 short, ring_id_1 short, xtal_id_2 short, ring_id_2 short, tbin_id short, w double"
#: Versions of the image that stay in its folder.
KEPT = 2


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events from Parquet files as they appear."""
    return spark.readStream.schema(EVENTS).parquet(folder)


def back_projection_stream(events: DataFrame, s: Scanner, tracer: str = "siddon") -> DataFrame:
    """vox and val so far: rays are stateless, and the state is one sum for each voxel."""
    return back(lines_of_response(events, s), s, "w", tracer)


def start(events: DataFrame, s: Scanner, folder: str, checkpoint: str, tracer: str = "siddon") -> StreamingQuery:
    """Writes the image so far to folder/version=n after each batch n; a batch that is repeated after a failure writes its version again."""

    def write(image: DataFrame, n: int) -> None:
        image.write.mode("overwrite").parquet(f"{folder}/version={n}")
        for path, version in versions(image.sparkSession, folder)[:-KEPT]:
            if version < n:
                path.getFileSystem(image.sparkSession._jsc.hadoopConfiguration()).delete(path, True)

    return back_projection_stream(events, s, tracer).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).start()


def versions(spark: SparkSession, folder: str) -> list:
    """(path, n) of the versions that are written whole, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in files.listStatus(path)] if files.exists(path) else []
    return sorted(((p, int(p.getName().removeprefix("version="))) for p in found if p.getName().startswith("version=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))), key=lambda x: x[1])


def latest(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest image; None before the first batch."""
    found = versions(spark, folder)
    return spark.read.parquet(found[-1][0].toString()) if found else None
