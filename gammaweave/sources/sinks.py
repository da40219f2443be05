"""Tables that a reconstruction leaves, as Parquet partitioned by what they are looked up by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_projection(y: DataFrame, folder: str, iteration: int, subset: int, phase: str = "main", name: str | None = "Px") -> None:
    """A subset's values by event: line integrals (Px), or those with the background (Px_r_s); without a name, y has a column of names."""
    named = y if name is None else y.withColumn("name", F.lit(name))
    named.withColumns({"phase": F.lit(phase), "iter": F.lit(iteration), "subset": F.lit(subset)}).write.mode("append").partitionBy("name", "phase", "iter", "subset").parquet(f"{folder}/projection")


def write_kernel(weights: DataFrame, nearest: DataFrame, folder: str) -> None:
    """Patch matching's weights (vox, nbr, w) and nearest places (vox, rank, nbr, d)."""
    weights.write.mode("overwrite").parquet(f"{folder}/ker_weight")
    nearest.write.mode("overwrite").parquet(f"{folder}/ker_ind")


def write_likelihood(rows: DataFrame, folder: str) -> None:
    rows.coalesce(1).write.mode("append").partitionBy("phase").parquet(f"{folder}/likelihood")


def write_image(image: DataFrame, folder: str, name: str, iteration: int | None = None) -> None:
    image.write.mode("overwrite").parquet(f"{folder}/{name}" + (f"/iter={iteration}" if iteration is not None else ""))
