"""A Spark data sink that fills one file from many tasks: each writes its blocks at their own places, and the file takes its name when all are done.

Rows are (place, block): bytes and where they begin. Tasks write to a file beside the target that all of them see; the commit renames it, an aborted job deletes it. A task that is run
again writes the same bytes at the same places, so lost executors and repeated attempts change nothing. Bytes that no block covers are 0.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

ROWS = "place bigint, block binary"


def local(path: str) -> str | None:
    """The path as the operating system names it; None where it lies in a store that files can't be opened in."""
    plain = re.sub("^file:/+", "/", path)
    return None if re.match("[A-Za-z][A-Za-z0-9+.-]*:/", plain) else plain


@dataclass
class Written(WriterCommitMessage):
    """Bytes that a task has written, and the end of the last of them."""

    bytes: int
    end: int


class Writer(DataSourceArrowWriter):
    """Made once a job, on the driver, and sent to the tasks."""

    def __init__(self, path: str, least: int):
        self.path, self.least = path, least
        folder, name = os.path.split(path)
        self.part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}.part")
        os.makedirs(folder or ".", exist_ok=True)
        with open(self.part, "wb"):
            pass

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        total = end = 0
        with open(self.part, "r+b") as f:
            for batch in iterator:
                for place, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    f.seek(place)
                    n = f.write(block.as_buffer())
                    total, end = total + n, max(end, place + n)
            f.flush()
            os.fsync(f.fileno())
        return Written(total, end)

    def commit(self, messages: list[Written | None]) -> None:
        """The file is as long as its last block or `least` asks for; less than the tasks have written means that they don't see the same folder."""
        end = max([self.least, *(m.end for m in messages if m)])
        if os.path.getsize(self.part) < max([0, *(m.end for m in messages if m)]):
            os.unlink(self.part)
            raise OSError(f"the tasks that write {self.path} don't share its folder with the driver")
        os.truncate(self.part, end)
        os.replace(self.part, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.part):
            os.unlink(self.part)


class ByteRanges(DataSource):
    """df.write.format("byte_ranges").mode("overwrite").option("least", bytes).save(path), for rows of place and block; found by the module pyspark_byte_ranges, where that is on the driver's path."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> Writer:
        if [f.name for f in schema.fields] != ["place", "block"]:
            raise ValueError("rows of byte_ranges have place and block")
        if not overwrite:
            raise ValueError("byte_ranges replaces a file, it doesn't append")
        path = local(self.options["path"])
        if path is None:
            raise ValueError(f"{self.options['path']} can't be opened as a file")
        return Writer(path, int(self.options.get("least", 0)))


def write(rows: DataFrame, path: str, least: int = 0) -> None:
    """Fills the file from the tasks of rows. A store without files that are opened at any place gets the blocks in order instead, from the driver, one partition at a time.

    The writer's steps are those of the data source, but the driver takes them itself, and nothing is registered: Spark would start Python workers beside it for either, which stay and take
    more memory than all that the driver holds of a file.
    """
    spark = rows.sparkSession
    if local(path) is None:
        _stream(spark, rows, path, least)
        return
    writer = Writer(local(path), least)

    def run(batches):
        done = writer.write(batches)
        yield pa.RecordBatch.from_pydict({"bytes": [done.bytes], "end": [done.end]})

    try:
        messages = [Written(*r) for r in rows.select("place", "block").mapInArrow(run, "bytes bigint, end bigint").collect()]
    except BaseException:
        writer.abort([])
        raise
    writer.commit(messages)


def _stream(spark: SparkSession, rows: DataFrame, path: str, least: int) -> None:
    """Through Spark's own file systems, which know every store that its readers do; renamed when whole."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    part = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}.part")
    files, at = target.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    out = files.create(part, True)
    try:
        for r in rows.orderBy("place").toLocalIterator(prefetchPartitions=True):
            out.write(bytearray(r["place"] - at) + r["block"])
            at = r["place"] + len(r["block"])
        out.write(bytearray(max(0, least - at)))
        out.close()
        files.delete(target, False)
        files.rename(part, target)
    except Exception:
        out.close()
        files.delete(part, False)
        raise


def single(spark: SparkSession, block: bytes, place: int = 0) -> DataFrame:
    """One block, such as a header."""
    return spark.range(1).select(F.lit(place).cast("long").alias("place"), F.lit(bytearray(block)).alias("block"))
