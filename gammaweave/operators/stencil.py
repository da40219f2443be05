"""Neighbourhood and patch stencils in numpy, over tiles of the image with a halo.

Each voxel is sent to its tile and to those that reach it, so a tile has all that its own voxels' stencils need, and their rows are made whole in it: one shuffle,
and no image on the driver or in one task. Sums over patches of 3 x 3 x 3 cells are running sums along the axes.
"""

from __future__ import annotations

from itertools import product as grid_of

import numpy as np
from pyspark.sql import DataFrame

from ..plans.scanner import Scanner
from .tiles import Block, Tiles, over_tiles

Offset = tuple[int, int, int]
#: Voxels along the edge of a stencil's tile, of which some arrays for each neighbour are held at once.
EDGE = 32


def weight(kind: str, t: np.ndarray, delta: float) -> np.ndarray:
    """A potential's derivative divided by its argument."""
    if kind == "quad":
        return np.full(t.shape, 2.0)
    if kind == "hyperbola":
        return 1 / np.sqrt(t * t + delta)
    if kind == "fair":
        return 1 / (np.abs(t) + delta)
    if kind == "huber":
        return np.where(np.abs(t) <= delta, 1.0, delta / np.maximum(np.abs(t), 1e-300))
    if kind == "hl":
        return 1 / (1 + (t / delta) ** 2)
    if kind == "hw":
        return np.exp(-((t / delta) ** 2))
    raise ValueError(kind)


def shifted(x: np.ndarray, o: Offset) -> np.ndarray:
    """x at each place's neighbour o = (di, dj, dk); wraps at the halo's edge, which no kept place reaches."""
    return np.roll(x, (-o[2], -o[1], -o[0]), (0, 1, 2))


def box(x: np.ndarray, reach: Offset) -> np.ndarray:
    """Sums over the cells within reach (i, j, k) of each place."""
    for axis, r in ((2, reach[0]), (1, reach[1]), (0, reach[2])):
        x = sum(np.roll(x, k, axis) for k in range(-r, r + 1))
    return x


def neighbourhood(block: Block, offsets: list[Offset], kind: str, delta: float, isotropic: bool) -> tuple[np.ndarray, np.ndarray]:
    """t1 and t2 of the voxels in the tile (and around it, less the halo)."""
    x = block.values
    pairs = [(x - shifted(x, o), block.kappa * shifted(block.kappa, o) / np.sqrt(sum(c * c for c in o))) for o in offsets]  # kappa is 0 outside
    if isotropic:
        w = weight(kind, np.sqrt(sum(g * d * d for d, g in pairs)), delta)
        both = [(w + shifted(w, o)) * g for o, (_, g) in zip(offsets, pairs, strict=True)]
    else:
        both = [2 * weight(kind, d, delta) * g for d, g in pairs]
    return sum(2 * b for b in both), sum(b * d for b, (d, _) in zip(both, pairs, strict=True))


def patches(block: Block, offsets: list[Offset], kind: str, delta: float, isotropic: bool) -> tuple[np.ndarray, np.ndarray]:
    """The same for differences of 3 x 3 x 3 patches. A cell's difference is in the patches of 27 pairs, whose weights are summed."""
    x, inside, cell = block.values, block.inside, (1, 1, 1)
    kk = [block.kappa * shifted(block.kappa, o) for o in offsets]
    d = [x - shifted(x, o) for o in offsets]
    if isotropic:
        w = weight(kind, np.sqrt(sum(k * box(e * e, cell) for k, e in zip(kk, d, strict=True))), delta)
        weights = [w * k for k in kk]
    else:
        weights = [weight(kind, np.sqrt(box(e * e, cell)), delta) * k for k, e in zip(kk, d, strict=True)]
    t1, t2 = np.zeros(x.shape), np.zeros(x.shape)
    for o, e, w in zip(offsets, d, weights, strict=True):
        total = box(w, cell)
        ends, back = total * (inside + shifted(inside, o)), tuple(-c for c in o)
        t1 += ends + shifted(ends, back)
        t2 += e * total - shifted(e * total, back)
    return t1, t2


def surrogate(image: DataFrame, s: Scanner, kind: str, delta: float, offsets: list[Offset], isotropic: bool, patch: bool) -> DataFrame:
    """vox, t1 and t2."""
    reach = max(max(map(abs, o)) for o in offsets)

    def make(block):
        t1, t2 = (patches if patch else neighbourhood)(block, offsets, kind, delta, isotropic)
        return [block.voxels().astype(np.int32), t1[block.kept].ravel(), t2[block.kept].ravel()]

    return over_tiles(image, Tiles(s, EDGE), 2 * reach + (2 if patch else 0), "vox int, t1 double, t2 double", make)


def window(h: int, hk: int) -> list[Offset]:
    """In the order of voxels."""
    return [(i, j, k) for k, j, i in grid_of(range(-hk, hk + 1), range(-h, h + 1), range(-h, h + 1))]


def distances(image: DataFrame, s: Scanner, patch: Offset, search: list[Offset], strides: Offset, nearest: int | None = None) -> DataFrame:
    """vox, nbr and d of the voxels at multiples of the strides (i, j, k): the squared difference of patches at each place of the search window that is in the volume.

    With nearest: only so many of least d (to nine decimals, of equal ones the earlier voxel), and their rank, from 1.
    """
    reach = max(max(map(abs, o)) for o in search)

    def make(block):
        x, inside, (i0, j0, k0) = block.values, block.inside, block.start
        k, j, i = (a.ravel() for a in np.meshgrid(*(np.arange(a) for a in block.shape), indexing="ij"))
        mine = np.flatnonzero(((i + i0) % strides[0] == 0) & ((j + j0) % strides[1] == 0) & ((k + k0) % strides[2] == 0))
        vox = block.voxels()[mine]
        found = []
        for o in search:
            e = x - shifted(x, o)
            found.append(np.where(shifted(inside, o)[block.kept].ravel()[mine] > 0, box(e * e, patch)[block.kept].ravel()[mine], np.inf))
        step = np.array([di + dj * s.n + dk * s.n * s.n for di, dj, dk in search])
        d = np.stack(found, 1)
        if nearest is None:
            row, col = np.nonzero(np.isfinite(d))
            return [vox[row].astype(np.int32), (vox[row] + step[col]).astype(np.int32), d[row, col]]
        d = np.round(d, 9)
        order = np.argsort(d, 1, kind="stable")[:, :nearest]
        best = np.take_along_axis(d, order, 1)
        row, rank = np.nonzero(np.isfinite(best))
        return [vox[row].astype(np.int32), (vox[row] + step[order[row, rank]]).astype(np.int32), best[row, rank], (rank + 1).astype(np.int32)]

    schema = "vox int, nbr int, d double" + (", rank int" if nearest is not None else "")
    return over_tiles(image.select("vox", "val"), Tiles(s, EDGE), reach + max(patch), schema, make)
