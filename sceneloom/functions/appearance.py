"""Colour and opacity as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import items


def _k(l: int, m: int) -> float:  # noqa: E741
    """Normalisation of the real spherical harmonic of degree l, order m."""
    k = math.sqrt((2 * l + 1) / (4 * math.pi) * math.factorial(l - abs(m)) / math.factorial(l + abs(m)))
    return k if m == 0 else k * math.sqrt(2)


C0 = _k(0, 0)
MAX_DEGREE = 4


def sh_basis(degree: int, x, y, z) -> list:
    """Real spherical harmonics at a unit direction, by degree, then order -l to l, with the Condon-Shortley phase.

    The polynomials come from recurrences: (x + iy)^m for the azimuth,
    associated Legendre functions without their sine power for the rest.
    """
    if not 0 <= degree <= MAX_DEGREE:
        raise ValueError("degrees 0 to 4 are supported")
    cos, sin = [1.0], [0.0]
    for m in range(degree):
        c, s = cos[m], sin[m]
        cos.append(x * c - y * s)
        sin.append(x * s + y * c)
    legendre: dict[tuple[int, int], object] = {}
    for m in range(degree + 1):
        legendre[m, m] = float((-1) ** m * math.prod(range(1, 2 * m, 2)))
        for n in range(m + 1, degree + 1):
            before = legendre[n - 2, m] * float(n + m - 1) if n - 2 >= m else 0.0
            legendre[n, m] = (z * legendre[n - 1, m] * float(2 * n - 1) - before) / float(n - m)
    return [(cos[m] if m >= 0 else sin[-m]) * legendre[n, abs(m)] * _k(n, m) for n in range(degree + 1) for m in range(-n, n + 1)]


def eval_sh(degree: int, coefficients: Column, x: Column, y: Column, z: Column) -> Column:
    """Sum of coefficients (as many as the degree has) times harmonics."""
    basis = sh_basis(degree, x, y, z)
    out = None
    for c, b in zip(items(coefficients, len(basis)), basis, strict=True):
        out = c * b if out is None else out + c * b
    return out


def rgb_to_sh(rgb: Column) -> Column:
    return (rgb - 0.5) / C0


def sh_to_rgb(sh: Column) -> Column:
    return sh * C0 + 0.5


def sh_degree_at(iteration: Column, most: int = 3, every: int = 1000) -> Column:
    return F.least(F.floor(iteration / every), F.lit(most)).cast("int")


def channel_coefficients(dc: Column, rest: Column, channel: int, per_channel: int) -> Column:
    """A channel's coefficients, from the constant ones and the others, which are stored channel by channel."""
    return F.concat(F.array(F.get(dc, F.lit(channel))), F.slice(rest, channel * per_channel + 1, per_channel))


def view_color(degree: int, dc: Column, rest: Column, position: list[Column], centre: list[Column], per_channel: int = 15, override: list[Column] | None = None) -> list[Column]:
    """RGB seen from ``centre``: harmonics in the direction to the primitive, plus a half, not below 0; or the colours that ``override`` gives."""
    if override is not None:
        return override
    d = [p - c for p, c in zip(position, centre, strict=True)]
    norm = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    unit = [v / norm for v in d]
    return [F.greatest(eval_sh(degree, channel_coefficients(dc, rest, k, per_channel), *unit) + 0.5, F.lit(0.0)) for k in range(3)]


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    """Clamped to the open interval (0, 1), where it is finite."""
    p = F.least(F.greatest(p, F.lit(1e-300)), F.lit(1 - 2**-53))
    return F.ln(p / (1 - p))


def apply_exposure(rgb: list[Column], m: Column) -> list[Column]:
    """Row vector times the left 3x3 of a 3x4, plus its last column, clamped to 0..1."""
    a = items(m, 12)
    return [F.least(F.greatest(rgb[0] * a[j] + rgb[1] * a[4 + j] + rgb[2] * a[8 + j] + a[4 * j + 3], F.lit(0.0)), F.lit(1.0)) for j in range(3)]


IDENTITY_EXPOSURE = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]


def composite_background(channel: Column, alpha: Column, background: Column | float) -> Column:
    return channel * alpha + background * (1 - alpha)
