"""Headerless little-endian files: events, factors, volumes and sparse matrices, read into DataFrames and written from them.

Files are read by ranges of records, each by a task that opens the file at its range; neither the driver nor any task holds a file. They are written
so too: each task puts its blocks at their places (see ranges), and a job that fails leaves no file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scanner import Scanner
from ..plans.store import scratch
from . import ranges

EVENT = np.dtype([("xtal_id_1", "<i2"), ("ring_id_1", "<i2"), ("xtal_id_2", "<i2"), ("ring_id_2", "<i2"), ("tbin_id", "<i2")])
#: Bits of i, j, k and weight in an entry of a quantised matrix, lowest first; 48 in all, without padding. By whether the axial field of view is long.
PACKED_BITS = {False: (11, 11, 9, 17), True: (11, 11, 17, 9)}
ENTRY_BYTES = 6
#: Records of a task's range, and of a batch.
RANGE, BATCH = 1 << 22, 1 << 18
#: Rows of a file that a join may still broadcast.
MOST_JOINED = 1 << 16
_SQL = {"i2": "smallint", "i4": "int", "i8": "bigint", "f4": "float", "f8": "double"}


def _opened(path: str):
    """The file, by the file systems that workers can open themselves: this machine's or a shared folder's, and those of the Arrow library."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file(path)
    system, inner = pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return system.open_input_file(inner)


def _read(f, offset: int, kind: np.dtype, n: int) -> np.ndarray:
    return np.frombuffer(f.read_at(n * kind.itemsize, offset), kind)


def records(spark: SparkSession, path: str, kind: np.dtype, id_name: str, rows: int | None = None) -> DataFrame:
    """One row for each fixed-length record, numbered by its place in the file, which is split among tasks; what follows the last whole record is not read.

    rows: so many records, those beyond the end of the file zeros, and none of what it has more.
    """
    names = kind.names or ("val",)
    fields = [f"{id_name} bigint", *(f"{n} {_SQL[(kind[n] if kind.names else kind).str[1:]]}" for n in names)]
    whole = file_length(spark, path) // kind.itemsize
    total = whole if rows is None else rows

    def run(batches):
        for batch in batches:
            with _opened(path) as f:
                for first in batch.column(0).to_pylist():
                    for at in range(first, min(first + RANGE, total), BATCH):
                        n = min(BATCH, first + RANGE - at, total - at)
                        a = _read(f, at * kind.itemsize, kind, max(0, min(n, whole - at)))
                        a = np.append(a, np.zeros(n - len(a), kind)) if len(a) < n else a
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(a))), *(pa.array(np.ascontiguousarray(a[n] if kind.names else a)) for n in names)], [id_name, *names])

    return _sized(_ranges(spark, total).mapInArrow(run, ", ".join(fields)), total)


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """The rows of a file, which Spark takes for as few as the ranges that they come from: beyond MOST_JOINED they are marked, so that no join sends them through the driver."""
    return df.hint("merge") if rows > MOST_JOINED else df


def _ranges(spark: SparkSession, total: int) -> DataFrame:
    return spark.range(0, total, RANGE, numPartitions=max(1, -(-total // RANGE)))


def read_events(spark: SparkSession, prefix: str, suffix: str = ".lm") -> DataFrame:
    """event_id and the five fields; a file without events is an error."""
    events = records(spark, prefix + suffix, EVENT, "event_id")
    if events.isEmpty():
        raise ValueError(f"{prefix}{suffix} has no events")
    return events


def read_factor(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """event_id and the factor; None where there is no such file."""
    return records(spark, path, np.dtype("<f4"), "event_id").withColumnRenamed("val", name) if _exists(spark, path) else None


def read_volume(spark: SparkSession, path: str, s: Scanner, missing: float | None = None) -> DataFrame:
    """vox and val of all voxels: 0 beyond the end of a short file, `missing` throughout if there is no file."""
    if not _exists(spark, path):
        if missing is None:
            raise FileNotFoundError(path)
        return spark.range(s.voxels).select(F.col("id").cast("int").alias("vox"), F.lit(float(missing)).alias("val"))
    return records(spark, path, np.dtype("<f4"), "id", s.voxels).selectExpr("CAST(id AS INT) AS vox", "CAST(val AS DOUBLE) AS val")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def file_length(spark: SparkSession, path: str) -> int:
    """Bytes; 0 where there is no such file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(p).getLen() if fs.exists(p) else 0


def _row_ranges(ends: Iterator[np.ndarray]) -> list[tuple[int, int, int]]:
    """(first row, rows, first entry) of ranges of about RANGE entries or rows, from the running numbers of entries up to each row, block by block."""
    out, row, first, entry, last = [], 0, 0, 0, 0
    for block in ends:
        for at in range(0, len(block), BATCH):
            row += len(block[at : at + BATCH])
            last = int(block[at : at + BATCH][-1])
            if last - entry >= RANGE or row - first >= RANGE:
                out.append((first, row - first, entry))
                first, entry = row, last
    return [*out, (first, row - first, entry)] if row > first else out


def _blocks(f, offset: int, kind: np.dtype, n: int) -> Iterator[np.ndarray]:
    for at in range(0, n, RANGE):
        yield _read(f, offset + at * kind.itemsize, kind, min(RANGE, n - at))


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """row, col (from 0) and val of: int32 rows, int32 columns, int64 entries, int32 entries of each row, int32 columns from 1, float32 values."""
    i4, f4 = np.dtype("<i4"), np.dtype("<f4")
    with _opened(path) as f:
        (rows, _), n = _read(f, 0, i4, 2).tolist(), int(_read(f, 8, np.dtype("<i8"), 1)[0])
        base, total = 16 + 4 * rows, 0

        def ends():
            nonlocal total
            for block in _blocks(f, 16, i4, rows):
                sums = total + np.cumsum(block, dtype=np.int64)
                total = int(sums[-1])
                yield sums

        ranges = _row_ranges(ends())
    if total != n or file_length(spark, path) < base + 8 * n:
        raise ValueError(f"{path} is cut short")

    def run(batches):
        for batch in batches:
            with _opened(path) as f:
                for r in batch.to_pylist():
                    counts = _read(f, 16 + 4 * r["first"], i4, r["rows"])
                    row = np.repeat(np.arange(r["first"], r["first"] + r["rows"], dtype=np.int32), counts)
                    col, val = (_read(f, base + skip + 4 * r["entry"], kind, len(row)) for skip, kind in ((0, i4), (4 * n, f4)))
                    for at in range(0, len(row), BATCH):
                        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + BATCH]) for x in (row, col - 1, val)], ["row", "col", "val"])

    return _sized(_planned(spark, ranges).mapInArrow(run, "row int, col int, val float"), n)


def _planned(spark: SparkSession, ranges: list) -> DataFrame:
    return spark.createDataFrame(ranges, "first long, rows long, entry long").repartition(max(1, len(ranges)))


def _dense(counts: DataFrame, rows: int, base: int, running: bool) -> DataFrame:
    """(place, block) of an int32 for each row from 0 on: its count, or with running, how many the rows before it have, and one more at the end; counts: row and n.

    The rows before a block of BATCH rows are added up by block, so the driver gets one number for each of at most 2^31 / BATCH blocks.
    """
    spark, n = counts.sparkSession, rows + running
    blocks = counts.groupBy(F.floor(F.col("row") / BATCH).alias("b")).agg(F.sum("n").alias("n")).collect() if running else []
    sums = np.zeros(-(-n // BATCH) + 1, np.int64)
    for b, k in blocks:
        sums[b + 1] = k
    sums = np.cumsum(sums)
    kind = pa.schema([("place", pa.int64()), ("block", pa.binary())])

    def make(key, table):
        b = key[0].as_py()
        out = np.zeros(min(BATCH, n - b * BATCH), np.int64)
        row, k = (table.column(c).to_numpy() for c in ("row", "n"))
        real = k > 0
        np.add.at(out, row[real] - b * BATCH, k[real])
        if running:
            out = sums[b] + np.cumsum(out) - out
        return pa.table([[base + 4 * b * BATCH], [out.astype("<i4").tobytes()]], schema=kind)

    marks = spark.range(0, n, BATCH).select(F.col("id").alias("row"), F.lit(0).cast("long").alias("n"))  # a row for each block, so that none is missing
    all_rows = counts.select(F.col("row").cast("long").alias("row"), F.col("n").cast("long").alias("n")).unionByName(marks)
    return all_rows.withColumn("b", F.floor(F.col("row") / BATCH)).groupBy("b").applyInArrow(make, ranges.ROWS)


def _placed(df: DataFrame, order: list[str], make: Callable[[dict[str, np.ndarray], int, int], Iterator[tuple[int, bytes]]]) -> tuple[DataFrame, DataFrame, int]:
    """The rows in their order as blocks: make(columns, number of the first of them, number of all) gives (place, block); with the ordered table and the number of its rows.

    Ranges of the order are written, each with the number of its rows; ranges are of rows, not of keys, so a key that holds most of them is in many. The driver gets a number for each range.
    """
    spark = df.sparkSession
    cut = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    table = scratch(spark)(cut)
    sizes = dict(table.groupBy("_range").count().collect())
    starts, total = {}, 0
    for k in sorted(sizes):
        starts[k], total = total, total + sizes[k]

    def run(batches):
        at: dict[int, int] = {}
        for batch in batches:
            of = batch.column(batch.num_columns - 1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1), len(of)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x < y:
                    k = int(of[x])
                    first = at.get(k, starts[k])
                    at[k] = first + int(y - x)
                    part = {name: batch.column(c).to_numpy(zero_copy_only=False)[x:y] for c, name in enumerate(batch.schema.names[:-1])}
                    places, blocks = zip(*make(part, first, total), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(blocks, pa.binary())], ["place", "block"])

    rows = table.repartition(max(1, len(starts)), "_range").sortWithinPartitions("_range", *order)
    return rows.mapInArrow(run, ranges.ROWS), table, total


def write_sparse(matrix: DataFrame, path: str, rows: int, cols: int) -> None:
    """The format that read_sparse reads."""
    one, base = matrix.selectExpr("CAST(row AS INT) AS row", "CAST(col + 1 AS INT) AS col", "CAST(val AS FLOAT) AS val"), 16 + 4 * rows

    def entries(part, first, total):
        yield base + 4 * first, part["col"].astype("<i4").tobytes()
        yield base + 4 * (total + first), part["val"].astype("<f4").tobytes()

    blocks, table, n = _placed(one, ["row", "col"], entries)
    head = np.array([rows, cols], "<i4").tobytes() + np.array([n], "<i8").tobytes()
    counts = table.groupBy("row").agg(F.count("*").alias("n"))
    ranges.write(ranges.single(matrix.sparkSession, head).union(_dense(counts, rows, 16, False)).union(blocks), path, base + 8 * n)


def pack(i, j, k, w, long_axial: bool = False) -> np.ndarray:
    """Entries as rows of six bytes."""
    out, at = np.zeros(len(i), "<u8"), 0
    for x, bits in zip((i, j, k, w), PACKED_BITS[long_axial], strict=True):
        out |= (np.asarray(x).astype("<u8") & np.uint64((1 << bits) - 1)) << np.uint64(at)
        at += bits
    return out.view(np.uint8).reshape(-1, 8)[:, :ENTRY_BYTES]


def unpack(entries: np.ndarray, long_axial: bool = False) -> list[np.ndarray]:
    """i, j, k and w of rows of six bytes."""
    wide = np.zeros((len(entries), 8), np.uint8)
    wide[:, :ENTRY_BYTES] = entries
    x, at, out = wide.view("<u8").ravel(), 0, []
    for bits in PACKED_BITS[long_axial]:
        out.append(((x >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int32))
        at += bits
    return out


def read_quantised(spark: SparkSession, path: str, long_axial: bool = False) -> tuple[DataFrame, float]:
    """row, i, j, k, w and the scale of: int32 rows, columns, entries, float32 scale, int32[rows + 1] offsets, entries of 48 bits."""
    i4 = np.dtype("<i4")
    with _opened(path) as f:
        rows, _, n = _read(f, 0, i4, 3).tolist()
        scale, base = float(_read(f, 12, np.dtype("<f4"), 1)[0]), 16 + 4 * (rows + 1)
        ranges = _row_ranges(block.astype(np.int64) for block in _blocks(f, 20, i4, rows))
    if file_length(spark, path) < base + ENTRY_BYTES * n:
        raise ValueError(f"{path} is cut short")

    def run(batches):
        for batch in batches:
            with _opened(path) as f:
                for r in batch.to_pylist():
                    offsets = _read(f, 16 + 4 * r["first"], i4, r["rows"] + 1).astype(np.int64)
                    row = np.repeat(np.arange(r["first"], r["first"] + r["rows"], dtype=np.int32), np.diff(offsets))
                    own = np.frombuffer(f.read_at(ENTRY_BYTES * len(row), base + ENTRY_BYTES * int(offsets[0])), np.uint8).reshape(-1, ENTRY_BYTES)
                    for at in range(0, len(row), BATCH):
                        yield pa.RecordBatch.from_arrays([pa.array(row[at : at + BATCH]), *(pa.array(x) for x in unpack(own[at : at + BATCH], long_axial))], ["row", "i", "j", "k", "w"])

    return _sized(_planned(spark, ranges).mapInArrow(run, "row int, i int, j int, k int, w int"), n), scale


def write_quantised(matrix: DataFrame, path: str, rows: int, cols: int, long_axial: bool = False) -> None:
    """The format that read_quantised reads; the scale is that of the rows, 0 without any."""
    spark, base = matrix.sparkSession, 16 + 4 * (rows + 1)
    scale = matrix.agg(F.max("scale")).first()[0] or 0.0

    def entries(part, first, total):
        yield base + ENTRY_BYTES * first, pack(*(part[c] for c in ("i", "j", "k", "w")), long_axial).tobytes()

    blocks, table, n = _placed(matrix.select(*(F.col(c).cast("int").alias(c) for c in ("row", "k", "j", "i", "w"))), ["row", "k", "j", "i"], entries)
    head = np.array([rows, cols, n], "<i4").tobytes() + np.array([scale], "<f4").tobytes()
    counts = table.groupBy("row").agg(F.count("*").alias("n"))
    ranges.write(ranges.single(spark, head).union(_dense(counts, rows, 16, True)).union(blocks), path, base + ENTRY_BYTES * n)


def write_records(df: DataFrame, path: str, kind: np.dtype, id_name: str) -> None:
    """Fixed-length records, that of id k at place k, fields by name (val where the type has none); zeros for ids between that have no row.

    Blocks of ids are dealt by their numbers, so df is computed once, and no order over all of it is needed.
    """
    names = kind.names or ("val",)
    fields = [F.col(n).cast(_SQL[(kind[n] if kind.names else kind).str[1:]]).alias(n) for n in names]
    rows = df.select(F.col(id_name).cast("long").alias("_id"), *fields).repartition(F.floor(F.col("_id") / BATCH)).sortWithinPartitions("_id")

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            packed = np.zeros(len(ids), kind)
            for c, name in enumerate(names, 1):
                target = packed[name] if kind.names else packed
                target[:] = batch.column(c).to_numpy(zero_copy_only=False)
            cuts = np.append(0, np.flatnonzero(np.diff(ids) != 1) + 1)
            blocks = [packed[x:y].tobytes() for x, y in zip(cuts, np.append(cuts[1:], len(ids)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[cuts] * kind.itemsize), pa.array(blocks, pa.binary())], ["place", "block"])

    ranges.write(rows.mapInArrow(run, ranges.ROWS), path)


def write_raw(df: DataFrame, path: str, id_name: str, value: str = "val") -> None:
    """float32 values, that of id k at place k; 0 for ids between that have no row."""
    write_records(df.select(id_name, F.col(value).alias("val")), path, np.dtype("<f4"), id_name)


def write_events(events: DataFrame, prefix: str, suffix: str = ".lm") -> None:
    """The format that read_events reads, by event_id."""
    write_records(events, prefix + suffix, EVENT, "event_id")
