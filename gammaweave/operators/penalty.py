"""Neighbourhood and patch penalties, numpy stencils over tiles of the image with a halo."""

from __future__ import annotations

from itertools import product as grid_of
from math import sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scanner import Scanner
from . import stencil


def offsets(spark: SparkSession, size: int) -> DataFrame:
    """n, di, dj, dk and g, one by the distance: 6 faces (size 0), or the cube of half-width `size`."""
    return spark.createDataFrame([(n, *o, 1 / sqrt(sum(x * x for x in o))) for n, o in enumerate(offset_list(size))], "n int, di int, dj int, dk int, g double")


def offset_list(size: int) -> list[tuple[int, int, int]]:
    reach = range(-max(size, 1), max(size, 1) + 1)
    return [(i, j, k) for k, j, i in grid_of(reach, reach, reach) if (i, j, k) != (0, 0, 0) and (size > 0 or abs(i) + abs(j) + abs(k) == 1)]


def surrogate(image: DataFrame, s: Scanner, kind: str = "quad", delta: float = 1.0, size: int = 0, isotropic: bool = False) -> DataFrame:
    """vox, t1 and t2 of the penalty's quadratic surrogate. Each unordered pair counts from both sides: a difference of two
    voxels adds its weight four times (t1), and its weighted difference twice (t2), to each where the weight is symmetric."""
    return stencil.surrogate(image, s, kind, delta, offset_list(size), isotropic, False)


def gradient(image: DataFrame, s: Scanner, kind: str = "quad", delta: float = 1.0, size: int = 0, isotropic: bool = False) -> DataFrame:
    """vox and grad of the penalty; a pair counts from both sides."""
    return surrogate(image, s, kind, delta, size, isotropic).select("vox", F.col("t2").alias("grad"))


def mean_surrogate(image: DataFrame, mean: DataFrame) -> DataFrame:
    """t1 = 1 and t2 = x - mean."""
    return image.join(mean.select("vox", F.col("val").alias("_m")), "vox").select("vox", F.lit(1.0).alias("t1"), (F.col("val") - F.col("_m")).alias("t2"))


def patch_surrogate(image: DataFrame, s: Scanner, kind: str = "quad", delta: float = 1.0, size: int = 0, isotropic: bool = False) -> DataFrame:
    """vox, t1 and t2 for differences of 3 x 3 x 3 patches, zero outside the volume."""
    return stencil.surrogate(image, s, kind, delta, offset_list(size), isotropic, True)


def patch_gradient(image: DataFrame, s: Scanner, kind: str = "quad", delta: float = 1.0, size: int = 0) -> DataFrame:
    return patch_surrogate(image, s, kind, delta, size).select("vox", F.col("t2").alias("grad"))


def fov_mask(image: DataFrame, s: Scanner) -> DataFrame:
    """image with val 0 beyond a circle of n div 2 + 10 around the middle, in whole voxels counted from 1."""
    c = f"{(s.n + 1) / 2}e0"
    far = f"pow(i + 1 - {c}, 2) + pow(j + 1 - {c}, 2) > {(s.n // 2 + 10) ** 2}"
    return image.selectExpr(*(x for x in image.columns if x != "val"), f"CASE WHEN {far} THEN 0e0 ELSE val END AS val")


__all__ = ["fov_mask", "gradient", "mean_surrogate", "offset_list", "offsets", "patch_gradient", "patch_surrogate", "surrogate"]
