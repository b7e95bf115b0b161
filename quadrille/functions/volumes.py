"""Bounding volumes: struct<kind, center, radius, half_axes>; kind is sphere or obb, half_axes are 9 doubles."""

from __future__ import annotations

from quadrille.functions import linear as L

TYPE = "struct<kind:string, center:array<double>, radius:double, half_axes:array<double>>"
#: Axes shorter than this have no direction.
FLAT = "1e-12D"


def sphere(center: str, radius: str) -> str:
    return f"named_struct('kind', 'sphere', 'center', {center}, 'radius', {radius}, 'half_axes', cast(null AS array<double>))"


def obb(center: str, half_axes: str) -> str:
    return f"named_struct('kind', 'obb', 'center', {center}, 'radius', cast(null AS double), 'half_axes', {half_axes})"


def _to(v: str, p: str) -> str:
    return "array(" + ", ".join(f"({p})[{k}] - ({v}).center[{k}]" for k in range(3)) + ")"


def distance(v: str, p: str) -> str:
    """Distance of a point from the volume; 0 inside."""
    ball = f"{L.length(_to(v, p))} - ({v}).radius"
    axes = f"({v}).half_axes"
    # Along each axis the part of the offset beyond the half length is left over.
    shares = []
    for k in (0, 3, 6):
        along = " + ".join(f"({p}[{i}] - ({v}).center[{i}]) * {axes}[{k + i}]" for i in range(3))
        size = L.length(axes, k)
        shares.append(f"if({size} < {FLAT}, 0D, greatest(-1D, least(1D, ({along}) / nullif({size} * {size}, 0D))))")
    left = "array(" + ", ".join(f"{p}[{i}] - ({v}).center[{i}]" + "".join(f" - {axes}[{k + i}] * {share}" for k, share in zip((0, 3, 6), shares, strict=True)) for i in range(3)) + ")"
    return f"greatest(0D, if(({v}).kind = 'sphere', {ball}, aggregate({left}, 0D, (s, x) -> s + x * x, s -> sqrt(s))))"


def bounding_radius(v: str) -> str:
    """Radius of the sphere around the volume's centre that holds it."""
    return f"if(({v}).kind = 'sphere', ({v}).radius, aggregate(({v}).half_axes, 0D, (s, x) -> s + x * x, s -> sqrt(s)))"


def moved(v: str, m: str) -> str:
    """The volume under a matrix; a sphere's radius grows by the largest scale."""
    c = L.point(m, f"({v}).center")
    axes = "array(" + ", ".join(L.vector(m, f"({v}).half_axes", k) for k in (0, 3, 6)) + ")"
    return f"if(({v}).kind = 'sphere', {sphere(c, f'({v}).radius * {L.max_scale(m)}')}, {obb(c, axes)})"


def in_frustum(v: str, planes: str, scale: str = "1D", margin: float = 1.25) -> str:
    """Whether the widened bounding sphere meets the inside of all planes (arrays a, b, c, d; the far plane is left out)."""
    dot = " + ".join(f"q[{k}] * ({v}).center[{k}]" for k in range(3))
    return f"forall({planes}, q -> {dot} + q[3] > -({bounding_radius(v)} * {margin}D * {scale}))"
