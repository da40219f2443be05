"""Sparse matrices in two-dimensional blocks, for products that come again and again.

A block of the matrix is edge rows by edge columns; its entries are packed as arrays and written once, in pieces of PIECE entries or so, dealt by a hash of row and column, so that a dense block, or a row or column
with most of all entries, is in many tasks. A product packs the vector by blocks of columns, sends each block to the groups of pieces that need it, and adds arrays, not rows: what is
shuffled is one array for each block of rows and group of pieces, and a tree of sums over these.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import Scratch

#: Rows and columns of a block, entries of a piece, and pieces of a group, or arrays that are added at once.
EDGE, PIECE, FAN = 1 << 16, 1 << 18, 16
_SUMS = pa.schema([("to", pa.int32()), ("own", pa.int32()), ("val", pa.binary()), ("met", pa.binary())])
_SUM_ROWS = "to int, own int, val binary, met binary"


@dataclass
class Blocked:
    """pieces: to and of (blocks of rows and of columns), salt (the group of pieces that it is dealt with), row and col (int32 places in the block) and val (doubles) as bytes;
    groups: of, and how many salts it has; most: the most pieces that a block of rows has."""

    pieces: DataFrame
    groups: DataFrame
    most: int
    edge: int

    def product(self, x: DataFrame) -> DataFrame:
        """id and val of A x; x has id (each once) and val. Rows of A that meet nothing have no row, nor do rows of x without a value count."""
        edge, most = self.edge, self.most
        copies = self._packed(x).join(self.groups, "of").withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).select("of", "salt", "val", "met")
        levels = -(-most // FAN)

        def met(key, pieces, vector):
            out = _SUMS.empty_table()
            if not pieces.num_rows or not vector.num_rows:
                return out
            value, has = _values(vector.slice(0, 1).to_pylist()[0], edge)
            own = (key[0].as_py() * 7919 + key[1].as_py()) % levels
            sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for at in range(pieces.num_rows):
                p = pieces.slice(at, 1).to_pylist()[0]
                row, col, val = np.frombuffer(p["row"], np.int32), np.frombuffer(p["col"], np.int32), np.frombuffer(p["val"])
                keep = has[col]
                row, part = row[keep], val[keep] * value[col[keep]]
                if len(row):
                    total, some = sums.setdefault(p["to"], (np.zeros(edge), np.zeros(edge, bool)))
                    total += np.bincount(row, part, edge)
                    some[row] = True
            return pa.concat_tables([out, *(_row(to, own, *s) for to, s in sums.items())])

        parts = self.pieces.groupBy("of", "salt").cogroup(copies.groupBy("of", "salt")).applyInArrow(met, _SUM_ROWS)
        while True:
            parts = parts.groupBy("to", "own").applyInArrow(lambda key, rows: _added(key, rows, edge), _SUM_ROWS)
            if levels == 1:
                break
            levels = -(-levels // FAN)
            parts = parts.withColumn("own", F.expr(f"CAST(own % {levels} AS INT)"))
        return self._unpacked(parts)

    def _packed(self, x: DataFrame) -> DataFrame:
        """of, val and met: the doubles of each block that has a row, and as bits where there are rows."""
        edge = self.edge

        def pack(key, rows):
            val, has = np.zeros(edge), np.zeros(edge, bool)
            at = rows.column("id").to_numpy() - key[0].as_py() * edge
            val[at], has[at] = rows.column("val").to_numpy(), True
            return pa.table([[key[0].as_py()], [val.tobytes()], [np.packbits(has).tobytes()]], schema=pa.schema([("of", pa.int32()), ("val", pa.binary()), ("met", pa.binary())]))

        rows = x.select(F.col("id").cast("long").alias("id"), F.col("val").cast("double").alias("val")).where("id IS NOT NULL AND val IS NOT NULL")
        return rows.withColumn("of", F.expr(f"CAST(id div {edge} AS INT)")).groupBy("of").applyInArrow(pack, "of int, val binary, met binary")

    def _unpacked(self, sums: DataFrame) -> DataFrame:
        edge = self.edge

        def run(batches):
            for batch in batches:
                for at in range(batch.num_rows):
                    r = batch.slice(at, 1).to_pylist()[0]
                    val, has = _values(r, edge)
                    yield pa.RecordBatch.from_arrays([pa.array(r["to"] * edge + np.flatnonzero(has)), pa.array(val[has])], ["id", "val"])

        return sums.select("to", "val", "met").mapInArrow(run, "id bigint, val double")


def _values(row: dict, edge: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["val"]), np.unpackbits(np.frombuffer(row["met"], np.uint8), count=edge).astype(bool)


def _row(to: int, own: int, val: np.ndarray, has: np.ndarray) -> pa.Table:
    return pa.table([[to], [own], [val.tobytes()], [np.packbits(has).tobytes()]], schema=_SUMS)


def _added(key, rows: pa.Table, edge: int) -> pa.Table:
    total, some = np.zeros(edge), np.zeros(edge, bool)
    for at in range(rows.num_rows):
        val, has = _values(rows.slice(at, 1).to_pylist()[0], edge)
        total += val
        some |= has
    return _row(key[0].as_py(), key[1].as_py(), total, some)


def write(matrix: DataFrame, store: Scratch, edge: int = EDGE, transposed: bool = False, piece: int = PIECE) -> Blocked:
    """Packs a matrix (row, col, val), or its transpose, and writes it; entries without a row, column or value are left out."""
    row, col = ("col", "row") if transposed else ("row", "col")
    rows = matrix.select(F.col(row).cast("long").alias("row"), F.col(col).cast("long").alias("col"), F.col("val").cast("double").alias("val")).dropna()
    rows = rows.selectExpr(f"CAST(row div {edge} AS INT) AS to", f"CAST(col div {edge} AS INT) AS of", f"CAST(row % {edge} AS INT) AS row", f"CAST(col % {edge} AS INT) AS col", "val")
    # one row for each block with more entries than a piece has, so few of them; of a huge matrix they are joined by a shuffle, which Spark decides by their size
    large = rows.groupBy("to", "of").count().where(f"count > {piece}").selectExpr("to", "of", f"CAST(ceil(count / {piece}) AS INT) AS parts")
    dealt = rows.join(large, ["to", "of"], "left").withColumn("piece", F.expr("CASE WHEN parts IS NULL THEN 0 ELSE CAST(pmod(xxhash64(row, col), parts) AS INT) END"))

    def pack(key, entries):
        arrays = [entries.column(c).to_numpy() for c in ("row", "col", "val")]
        return pa.table([[key[0].as_py()], [key[1].as_py()], [key[2].as_py()], *([a.tobytes()] for a in arrays)], schema=schema)

    schema = pa.schema([("to", pa.int32()), ("of", pa.int32()), ("piece", pa.int32()), ("row", pa.binary()), ("col", pa.binary()), ("val", pa.binary())])
    packed = store(dealt.select("to", "of", "piece", "row", "col", "val").groupBy("to", "of", "piece").applyInArrow(pack, "to int, of int, piece int, row binary, col binary, val binary"))
    groups = store(packed.groupBy("of").agg(F.expr(f"CAST(ceil(count(*) / {FAN}) AS INT)").alias("salts")))
    most = packed.groupBy("to").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    salted = packed.join(groups, "of").withColumn("salt", F.expr("CAST(pmod(xxhash64(to, piece), salts) AS INT)")).drop("piece", "salts")
    return Blocked(salted, groups, int(most), edge)
