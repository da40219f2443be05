"""A scanner and its image grid."""

from __future__ import annotations

from dataclasses import dataclass
from math import erf, sqrt

#: Images of up to so many voxels, and dimension tables of up to so many rows, are broadcast.
MOST_BROADCAST = 1 << 20
LUT_SIZE = 512


@dataclass(frozen=True)
class Scanner:
    """Lengths in mm, times in ps. n and nk: voxels in the plane (both ways) and along the axis."""

    modules: int = 12
    crystals: int = 4
    rings: int = 8
    ring_diameter: float = 120.0
    depth: float = 10.0
    pitch: float = 7.9
    ring_pitch: float = 4.0
    n: int = 16
    nk: int = 8
    voxel: float = 4.0
    voxel_k: float = 4.0
    half_step: bool = False
    tof_fwhm_ps: float = 300.0
    tof_bin_ps: float = 200.0

    def __post_init__(self):
        for name in ("modules", "crystals", "rings", "ring_diameter", "ring_pitch", "n", "nk", "voxel", "voxel_k"):
            if not getattr(self, name) > 0:
                raise ValueError(f"{name} must be positive, not {getattr(self, name)}")

    @property
    def per_ring(self) -> int:
        return self.modules * self.crystals

    @property
    def voxels(self) -> int:
        return self.n * self.n * self.nk

    @property
    def sigma(self) -> float:
        return self.tof_fwhm_ps * 0.15 / 2.355

    @property
    def spacing(self) -> float:
        return self.tof_bin_ps * 0.15

    @property
    def lut_step(self) -> float:
        return 3.0 * self.sigma / LUT_SIZE

    def lut(self) -> list[float]:
        """The share of a Gaussian that a time bin holds, at distances of whole steps from its centre up to three sigma."""
        half, width = self.spacing / 2, self.sigma * sqrt(2.0)
        return [(erf((i * self.lut_step + half) / width) - erf((i * self.lut_step - half) / width)) / 2 for i in range(LUT_SIZE)]


SMALL = Scanner()
