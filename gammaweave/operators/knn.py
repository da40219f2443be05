"""Patch matching: kernels, nearest neighbours, and the filters that they make."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import _num, inside, linear
from ..plans.scanner import Scanner
from . import stencil
from .geometry import small


@dataclass(frozen=True)
class Matching:
    """Half sizes of the patch and of the search window, in the plane and along k, and the strides of the sampled blocks."""

    patch: int = 1
    patch_k: int = 1
    window: int = 1
    window_k: int = 1
    stride: int = 2
    stride_k: int = 2

    @property
    def patches(self) -> tuple[int, int, int]:
        return self.patch, self.patch, self.patch_k

    @property
    def search(self) -> list[tuple[int, int, int]]:
        return stencil.window(self.window, self.window_k)


def _cube(name: str, h: int, hk: int) -> str:
    cells = ", ".join(f"named_struct('di', {i}, 'dj', {j}, 'dk', {k})" for k in range(-hk, hk + 1) for j in range(-h, h + 1) for i in range(-h, h + 1))
    return f"explode(array({cells})) AS {name}"


def blocks(image: DataFrame, m: Matching) -> DataFrame:
    """The sampled blocks' centres."""
    return image.where(f"i % {m.stride} = 0 AND j % {m.stride} = 0 AND k % {m.stride_k} = 0").select("vox", "i", "j", "k")


def kernel_weights(image: DataFrame, s: Scanner, m: Matching, h: float) -> DataFrame:
    """vox, nbr and w = exp(-d / h) for every voxel and place of its window."""
    return stencil.distances(image, s, m.patches, m.search, (1, 1, 1)).select("vox", "nbr", F.expr(f"exp(-d / {_num(h)})").alias("w"))


def nearest(image: DataFrame, s: Scanner, m: Matching, k: int) -> DataFrame:
    """vox, rank (from 1), nbr and d: the k places of least d for each sampled block, itself included; ties go by place (on d to nine decimals)."""
    return stencil.distances(image, s, m.patches, m.search, (m.stride, m.stride, m.stride_k), k).select("vox", "rank", "nbr", "d")


def coverage(image: DataFrame, s: Scanner, m: Matching) -> DataFrame:
    """vox and n: how many sampled blocks' patches hold each voxel; those in none have no row."""
    rows = blocks(image, m).selectExpr("i", "j", "k", _cube("p", m.patch, m.patch_k)).where(inside(s, "i + p.di", "j + p.dj", "k + p.dk"))
    return rows.selectExpr(f"CAST({linear(s, '(i + p.di)', '(j + p.dj)', '(k + p.dk)')} AS INT) AS vox").groupBy("vox").agg(F.count("*").alias("n"))


def _cells(knn: DataFrame, s: Scanner, m: Matching) -> DataFrame:
    """The voxels, in the volume, of each block (a) and of its neighbour's (b) patch, cell by cell."""
    n = s.n
    ijk = lambda v: (f"{v} % {n}", f"{v} div {n} % {n}", f"{v} div {n * n}")
    rows = knn.selectExpr("vox", "nbr", _cube("p", m.patch, m.patch_k))
    for v, name in (("vox", "a"), ("nbr", "b")):
        c = [f"({x} + p.{d})" for x, d in zip(ijk(v), ("di", "dj", "dk"), strict=True)]
        rows = rows.selectExpr("*", f"CASE WHEN {inside(s, *c)} THEN CAST({linear(s, *c)} AS INT) END AS {name}")
    return rows.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")


def filter_forward(image: DataFrame, knn: DataFrame, s: Scanner, m: Matching, k: int) -> DataFrame:
    """vox and val: each block's patch is the mean of its neighbours', summed over blocks and divided by coverage; null where that is none."""
    sums = _cells(knn, s, m).join(small(image.select(F.col("vox").alias("b"), "val"), s.voxels), "b").groupBy(F.col("a").alias("vox")).agg(F.sum(F.col("val") / k).alias("t"))
    out = image.select("vox").join(sums, "vox", "left").join(coverage(image, s, m), "vox", "left")
    return out.select("vox", F.expr("CASE WHEN n > 0 THEN coalesce(t, 0e0) / n END").alias("val"))


def filter_backward(image: DataFrame, knn: DataFrame, s: Scanner, m: Matching, k: int) -> DataFrame:
    """vox and val: the transpose of filter_forward; voxels that nothing reaches have 0."""
    scaled = image.select("vox", "val").join(coverage(image, s, m), "vox").select(F.col("vox").alias("a"), (F.col("val") / F.col("n")).alias("v"))
    sums = _cells(knn, s, m).join(small(scaled, s.voxels), "a").groupBy(F.col("b").alias("vox")).agg(F.sum(F.col("v") / k).alias("t"))
    return image.select("vox").join(sums, "vox", "left").select("vox", F.coalesce("t", F.lit(0.0)).alias("val"))
