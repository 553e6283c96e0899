"""What a stored primitive means: raw columns to opacity, scales, rotation, covariance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .appearance import sigmoid
from .geometry import _dot, items, normalized, once, quat_to_rotmat_normalized


def activate(opacity: Column, scale: Column, rot: Column, opacity_of: Callable = sigmoid, scale_of: Callable = F.exp) -> dict[str, Column]:
    """Opacity from its logit, scales from their logarithms, a unit quaternion; the first two by functions of the caller's choice."""
    return {"opacity": opacity_of(opacity), "scale": F.transform(scale, scale_of), "rot": normalized(rot, 4)}


def covariance6(scale: Column, rot: Column, modifier: float = 1.0) -> Column:
    """xx, xy, xz, yy, yz, zz of R S S R^T, from activated scales and a quaternion of any length."""
    rows = lambda r, s: F.array(*[F.get(r, F.lit(3 * i + k)) * F.get(s, F.lit(k)) * modifier for i in range(3) for k in range(3)])

    def products(m: Column) -> Column:
        v = items(m, 9)
        return F.array(*[_dot(v[3 * i : 3 * i + 3], v[3 * j : 3 * j + 3]) for i in range(3) for j in range(i, 3)])

    return once(once(scale, lambda s: once(quat_to_rotmat_normalized(rot), lambda r: rows(r, s))), products)
