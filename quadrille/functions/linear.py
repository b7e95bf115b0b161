"""4x4 matrices as column-major arrays of 16 doubles, and points as arrays of 3, in SQL expression text.

Text rather than Column objects, so that the same expression serves DataFrames and recursive SQL.
"""

from __future__ import annotations

IDENTITY = "array(1D,0D,0D,0D, 0D,1D,0D,0D, 0D,0D,1D,0D, 0D,0D,0D,1D)"
#: glTF's y-up content into z-up tile space.
YUP_TO_ZUP = "array(1D,0D,0D,0D, 0D,0D,1D,0D, 0D,-1D,0D,0D, 0D,0D,0D,1D)"
#: z-up tile space into a y-up world.
ZUP_TO_YUP = "array(1D,0D,0D,0D, 0D,0D,-1D,0D, 0D,1D,0D,0D, 0D,0D,0D,1D)"


def multiply(a: str, b: str) -> str:
    """a x b: what b does first."""
    terms = " + ".join(f"({a})[4 * {k} + i % 4] * ({b})[i - i % 4 + {k}]" for k in range(4))
    return f"transform(sequence(0, 15), i -> {terms})"


def point(m: str, p: str) -> str:
    """The point p moved by m."""
    return "array(" + ", ".join(" + ".join(f"({m})[{4 * k + r}] * ({p})[{k}]" for k in range(3)) + f" + ({m})[{12 + r}]" for r in range(3)) + ")"


def vector(m: str, v: str, at: int = 0) -> str:
    """The elements of the vector v[at..at+2] turned and scaled by m."""
    return ", ".join(" + ".join(f"({m})[{4 * k + r}] * ({v})[{at + k}]" for k in range(3)) for r in range(3))


def length(v: str, at: int = 0) -> str:
    return "sqrt(" + " + ".join(f"({v})[{at + k}] * ({v})[{at + k}]" for k in range(3)) + ")"


def max_scale(m: str) -> str:
    """Length of the longest column: a bound on what m does to a radius."""
    return f"greatest({length(m)}, {length(m, 4)}, {length(m, 8)})"


def translation(t: str) -> str:
    return f"array(1D,0D,0D,0D, 0D,1D,0D,0D, 0D,0D,1D,0D, ({t})[0], ({t})[1], ({t})[2], 1D)"


def placed(world_from_ecef: str, ecef_from_content: str, rtc_center: str) -> str:
    """World matrix of content given in ECEF, with an optional relative-to-centre offset, composed in doubles."""
    return multiply(world_from_ecef, f"if({rtc_center} is null, {ecef_from_content}, {multiply(ecef_from_content, translation(rtc_center))})")
