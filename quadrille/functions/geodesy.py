"""WGS84 geodesy in SQL expression text; angles of regions are radians, of points degrees."""

from __future__ import annotations

import math

from quadrille.functions import linear as L
from quadrille.functions import volumes as V

#: WGS84's equatorial radius and flattening.
RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563
ECC2 = FLATTENING * (2 - FLATTENING)
#: Region spans up to this many radians become boxes; wider ones the globe's sphere.
WIDEST = 0.5
#: A root this many metres from the origin stands on a planet.
PLANETARY = 2_000_000.0


def _ecef(lat: str, lon: str, h: str) -> tuple[str, str, str]:
    n = f"({RADIUS!r}D / sqrt(1D - {ECC2!r}D * sin({lat}) * sin({lat})))"
    return f"({n} + {h}) * cos({lat}) * cos({lon})", f"({n} + {h}) * cos({lat}) * sin({lon})", f"({n} * (1D - {ECC2!r}D) + {h}) * sin({lat})"


def ecef(lat: str, lon: str, h: str) -> str:
    """Array x, y, z of a point in degrees and metres."""
    return "array(" + ", ".join(_ecef(f"radians({lat})", f"radians({lon})", h)) + ")"


def enu(lat: str, lon: str) -> str:
    """East, north and up at a point in radians, as 9 doubles."""
    return f"array(-sin({lon}), cos({lon}), 0D, -sin({lat}) * cos({lon}), -sin({lat}) * sin({lon}), cos({lat}), cos({lat}) * cos({lon}), cos({lat}) * sin({lon}), sin({lat}))"


def world_from_ecef(lat: str, lon: str, elevation: str) -> str:
    """Matrix from ECEF into the y-up frame at an origin in degrees: x east, y up, z south."""
    b, o = enu(f"radians({lat})", f"radians({lon})"), ecef(lat, lon, elevation)
    rows = [[f"({b})[{k}]" for k in range(3)], [f"({b})[{k}]" for k in range(6, 9)], [f"-({b})[{k}]" for k in range(3, 6)]]
    columns = [", ".join(rows[r][c] for r in range(3)) + ", 0D" for c in range(3)]
    shift = ", ".join("-(" + " + ".join(f"{rows[r][k]} * ({o})[{k}]" for k in range(3)) + ")" for r in range(3))
    return f"array({', '.join(columns)}, {shift}, 1D)"


def region_usable(r: str) -> str:
    """Whether west, south, east, north, low, high spans a patch small enough for a box; across the antimeridian it doesn't."""
    return f"(({r})[2] - ({r})[0] > 0D AND ({r})[2] - ({r})[0] <= {WIDEST}D AND ({r})[3] - ({r})[1] > 0D AND ({r})[3] - ({r})[1] <= {WIDEST}D)"


def region_volume(r: str) -> str:
    """Volume of a region: the east-north-up box around a 3 x 3 grid at both heights, or the globe's sphere."""
    lat, lon = f"((({r})[1] + ({r})[3]) * 0.5D)", f"((({r})[0] + ({r})[2]) * 0.5D)"
    at = "array(" + ", ".join(_ecef(lat, lon, "0D")) + ")"
    parts = []
    for i in range(3):
        for j in range(3):
            for h in (4, 5):
                parts.append("array(" + ", ".join(_ecef(f"(({r})[1] + (({r})[3] - ({r})[1]) * {i / 2}D)", f"(({r})[0] + (({r})[2] - ({r})[0]) * {j / 2}D)", f"({r})[{h}]")) + ")")
    grid = f"array({', '.join(parts)})"
    # Bound once, used often: a one-element array's transform names a value.
    along = lambda k: f"transform(g, q -> (q[0] - o[0]) * b[{3 * k}] + (q[1] - o[1]) * b[{3 * k + 1}] + (q[2] - o[2]) * b[{3 * k + 2}])"
    low = "array(" + ", ".join(f"array_min({along(k)})" for k in range(3)) + ")"
    high = "array(" + ", ".join(f"array_max({along(k)})" for k in range(3)) + ")"
    center = "array(" + ", ".join(f"o[{i}] + " + " + ".join(f"b[{3 * k + i}] * (lo[{k}] + hi[{k}]) * 0.5D" for k in range(3)) for i in range(3)) + ")"
    axes = "array(" + ", ".join(f"b[{3 * k + i}] * (hi[{k}] - lo[{k}]) * 0.5D" for k in range(3) for i in range(3)) + ")"
    box = f"transform(array({grid}), g -> transform(array({at}), o -> transform(array({enu(lat, lon)}), b -> transform(array({low}), lo -> transform(array({high}), hi -> {V.obb(center, axes)})[0])[0])[0])[0])[0]"
    globe = V.sphere("array(0D, 0D, 0D)", f"{RADIUS!r}D + greatest(({r})[5], 0D)")
    return f"if({region_usable(r)}, {box}, {globe})"


def georeferenced(region: str, center: str, transform: str) -> str:
    """Whether a root has a region, or its centre after its transform is planetary metres away."""
    return f"coalesce({region} is not null OR {L.length(L.point(f'coalesce({transform}, {L.IDENTITY})', center))} > {PLANETARY}D, false)"


def planetary(metres: float) -> bool:
    return math.isfinite(metres) and metres > PLANETARY
