"""Scalar formulas as SQL text; they hold no engine-specific syntax."""

from __future__ import annotations

from ..plans.scanner import Scanner

POTENTIALS = ("quad", "hyperbola", "fair", "huber", "hl", "hw")


def _num(x: float) -> str:
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def slab(p: str, d: str, b: float) -> tuple[str, str]:
    """Where a ray enters and leaves abs(p) <= b. One parallel to it is inside for all of it, or (from 2 to -1) nowhere."""
    b_ = _num(b)
    one, two = f"((-{b_} - {p}) / nullif({d}, 0e0))", f"(({b_} - {p}) / nullif({d}, 0e0))"
    inside = f"{p} BETWEEN -{b_} AND {b_}"
    return f"CASE WHEN {d} = 0e0 THEN CASE WHEN {inside} THEN 0e0 ELSE 2e0 END ELSE least({one}, {two}) END", f"CASE WHEN {d} = 0e0 THEN CASE WHEN {inside} THEN 1e0 ELSE -1e0 END ELSE greatest({one}, {two}) END"


def hit(s: Scanner, axes: str = "xyz") -> tuple[str, str]:
    """Entry and exit of the box between the outer voxels' centres, within the ray; it is hit if the first is smaller."""
    size = {"x": (s.n / 2 - 0.5) * s.voxel, "y": (s.n / 2 - 0.5) * s.voxel, "z": (s.nk / 2 - 0.5) * s.voxel_k}
    both = [slab(f"{a}0", f"d{a}", size[a]) for a in axes]
    return f"greatest(0e0, {', '.join(x for x, _ in both)})", f"least(1e0, {', '.join(x for _, x in both)})"


def cylinder(s: Scanner) -> tuple[str, str, str]:
    """The discriminant (hit if positive), and entry and exit of the cylinder through the outer voxels' centres."""
    r = _num((s.n - 1) * s.voxel / 2)
    det = f"((dx * dx + dy * dy) * {r} * {r} - (dx * y0 - dy * x0) * (dx * y0 - dy * x0))"
    root = f"sqrt(greatest({det}, 0e0))"
    return det, f"(-(dx * x0 + dy * y0) - {root}) / nullif(dx * dx + dy * dy, 0e0)", f"(-(dx * x0 + dy * y0) + {root}) / nullif(dx * dx + dy * dy, 0e0)"


def voxel_of(s: Scanner, x: str, y: str, z: str) -> tuple[str, str, str]:
    """i runs against y, j along x and k along z."""
    h, hk, v, vk = _num(s.n * s.voxel / 2), _num(s.nk * s.voxel_k / 2), _num(s.voxel), _num(s.voxel_k)
    return f"CAST(floor(({h} - ({y})) / {v}) AS INT)", f"CAST(floor((({x}) + {h}) / {v}) AS INT)", f"CAST(floor((({z}) + {hk}) / {vk}) AS INT)"


def centre(n: int, v: float, index: str, back: bool = False) -> str:
    return f"(({_num(n / 2 - 0.5)} - {index}) * {_num(v)})" if back else f"(({index} - {_num(n / 2 - 0.5)}) * {_num(v)})"


def inside(s: Scanner, i: str = "i", j: str = "j", k: str = "k") -> str:
    return f"{i} BETWEEN 0 AND {s.n - 1} AND {j} BETWEEN 0 AND {s.n - 1} AND {k} BETWEEN 0 AND {s.nk - 1}"


def linear(s: Scanner, i: str = "i", j: str = "j", k: str = "k") -> str:
    return f"({i} + {j} * {s.n} + {k} * {s.n * s.n})"


def phi(kind: str, t: str, delta: float) -> str:
    """The penalty of a difference t."""
    d = _num(delta)
    return {
        "quad": f"({t}) * ({t})",
        "hyperbola": f"sqrt(({t}) * ({t}) + {d})",
        "fair": f"{d} * (({t}) / {d} - ln(1e0 + abs(({t}) / {d})))",
        "huber": f"CASE WHEN abs({t}) <= {d} THEN ({t}) * ({t}) / 2e0 ELSE {d} * abs({t}) - {d} * {d} / 2e0 END",
        "hl": f"{d} * {d} / 2e0 * ln(1e0 + (({t}) / {d}) * (({t}) / {d}))",
        "hw": f"1e0 - exp(-(({t}) / {d}) * (({t}) / {d}))",
    }[kind]


def slope_over_t(kind: str, t: str, delta: float) -> str:
    """The penalty's derivative divided by t, as a weight."""
    d = _num(delta)
    return {
        "quad": "2e0",
        "hyperbola": f"1e0 / sqrt(({t}) * ({t}) + {d})",
        "fair": f"1e0 / (abs({t}) + {d})",
        "huber": f"CASE WHEN abs({t}) <= {d} THEN 1e0 ELSE {d} / nullif(abs({t}), 0e0) END",
        "hl": f"1e0 / (1e0 + (({t}) / {d}) * (({t}) / {d}))",
        "hw": f"exp(-(({t}) / {d}) * (({t}) / {d}))",
    }[kind]


def slope(kind: str, t: str, delta: float) -> str:
    """The penalty's derivative."""
    d = _num(delta)
    return f"CASE WHEN abs({t}) <= {d} THEN {t} ELSE {d} * sign({t}) END" if kind == "huber" else f"({t}) * ({slope_over_t(kind, t, delta)})"
