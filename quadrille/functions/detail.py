"""Screen-space error, its relaxed threshold and load keys, in SQL expression text."""

from __future__ import annotations

from quadrille.functions import volumes as V

#: Nearer than this a camera is inside.
INSIDE = "1e-9D"


def screen_space_error(error: str, dist: str, k_px: str) -> str:
    return f"if({dist} <= {INSIDE}, double('infinity'), {error} * {k_px} / nullif({dist}, 0D))"


def threshold(base: str, dist: str, height: str, falloff: str) -> str:
    """The base threshold, relaxed with distance beyond the camera's height where there is a falloff."""
    return f"{base} * if({falloff} > 0D, 1D + greatest({dist} - {height}, 0D) / nullif({falloff}, 0D), 1D)"


def load_key(v: str, dist: str, cam: str, forward: str) -> str:
    """Distance, up to three times as much for what is behind the camera."""
    to = [f"(({v}).center[{k}] - ({cam})[{k}])" for k in range(3)]
    far = " + ".join(f"{t} * {t}" for t in to)
    cos = f"greatest(-1D, least(1D, ({' + '.join(f'{t} * ({forward})[{k}]' for k, t in enumerate(to))}) / nullif(sqrt({far}), 0D)))"
    r = V.bounding_radius(v)
    return f"{dist} * (2D - if({far} <= greatest({r} * {r}, 1e-12D), 1D, {cos}))"


def pressure(resident: str, budget: str, external: str = "1D") -> str:
    """Factor on the threshold: 1 within the budget or without one, then bytes over budget, times what the host adds; 8 at most."""
    own = f"if({budget} = 0 OR {resident} <= {budget}, 1D, least(8D, cast({resident} AS double) / nullif(cast({budget} AS double), 0D)))"
    return f"least(8D, {own} * greatest({external}, 1D))"


def halted(resident: str, budget: str, brake: str = "false") -> str:
    """Whether no load starts: a budget exceeded by half, or the host's brake."""
    return f"(({budget} > 0 AND {resident} > ({budget} * 3) div 2) OR {brake})"
