"""Sparse matrices as rows (row, col, val), numbered from 0, and the blur that two of them make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scanner import Scanner
from .geometry import small

LEVELS = (1 << 17) - 1


def product(matrix: DataFrame, x: DataFrame, transposed: bool = False) -> DataFrame:
    """id and val of A x, or of its transpose's; x has id and val. Rows of A that meet nothing have no row."""
    on, by = ("row", "col") if transposed else ("col", "row")
    met = matrix.select(F.col(on).alias("_on"), F.col(by).alias("_by"), F.col("val").alias("_a")).join(x.select(F.col("id").alias("_on"), F.col("val").alias("_x")), "_on")
    return met.groupBy(F.col("_by").alias("id")).agg(F.sum(F.col("_a") * F.col("_x")).alias("val"))


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def pick_rows(matrix: DataFrame, request: DataFrame) -> DataFrame:
    """The rows that request (new_row, old_row) names, renumbered; one named twice comes twice."""
    return matrix.join(request.select("new_row", F.col("old_row").alias("row")), "row").select(F.col("new_row").cast("int").alias("row"), "col", "val")


def nonempty_rows(matrix: DataFrame) -> DataFrame:
    """nz_row, row and n: rows with entries, numbered from 0 in order. Numbers are ranks of a list of rows, not of entries."""
    rows = matrix.groupBy("row").agg(F.count("*").alias("n"))
    block = F.floor(F.col("row") / 65536)
    per = rows.groupBy(block.alias("b")).agg(F.count("*").alias("c"))
    from pyspark.sql import Window

    # rank within a block of row numbers, and how many rows the blocks before it have
    before = per.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    ranked = rows.withColumn("b", block).withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("row")) - 1)
    # rows are int32, so there are 32,768 blocks at most
    return ranked.join(F.broadcast(before), "b").select((F.col("k") + F.col("before")).cast("int").alias("nz_row"), "row", "n")


def quantise(matrix: DataFrame, s: Scanner, levels: int = LEVELS) -> DataFrame:
    """row, i, j, k, w and scale: whole weights w with val about w * scale, and the column as a voxel's indices; scale is the largest value by levels."""
    top = matrix.agg(F.max("val")).first()[0]  # one number, without which no row can be made
    return matrix.withColumn("scale", F.lit(None if top is None else float(top) / levels).cast("double")).selectExpr("row", f"CAST(col % {s.n} AS INT) AS i", f"CAST(col div {s.n} % {s.n} AS INT) AS j", f"CAST(col div {s.n * s.n} AS INT) AS k", "CAST(floor(val / nullif(scale, 0e0)) AS INT) AS w", "scale")


def unquantised(matrix: DataFrame, s: Scanner) -> DataFrame:
    """row, col and val of quantised rows."""
    return matrix.selectExpr("row", f"CAST(i + j * {s.n} + k * {s.n * s.n} AS INT) AS col", "w * scale AS val")


def quantised_product(matrix: DataFrame, x: DataFrame, s: Scanner, transposed: bool = False) -> DataFrame:
    """A x, or its transpose's, for quantised rows."""
    return product(unquantised(matrix, s), x, transposed)


def blur(image: DataFrame, s: Scanner, transaxial: DataFrame | None, axial: DataFrame | None, transposed: bool = False) -> DataFrame:
    """vox and val: each plane by the transaxial matrix over i + n j, then along k by the axial one; a missing matrix leaves things as they are."""
    plane = s.n * s.n
    rows = image.selectExpr(f"CAST(vox % {plane} AS INT) AS ij", f"CAST(vox div {plane} AS INT) AS k", "val")
    for matrix, on, other in ((transaxial, "ij", "k"), (axial, "k", "ij")):
        if matrix is not None:
            m = transpose(matrix) if transposed else matrix
            m = m.select(F.col("col").alias(on), F.col("row").alias("_to"), F.col("val").alias("_a"))
            met = rows.join(small(m, s.nk**2 if on == "k" else plane**2), on)  # no matrix has more entries than that
            rows = met.groupBy(F.col("_to").alias(on), other).agg(F.sum(F.col("val") * F.col("_a")).alias("val"))
    return rows.selectExpr(f"CAST(ij + k * {plane} AS INT) AS vox", "val")
