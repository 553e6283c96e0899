"""Camera geometry as column expressions. Matrices are row-major arrays of doubles; rotations are world to camera."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: list[Column], b: list[Column]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def items(array: Column, n: int) -> list[Column]:
    return [F.get(array, F.lit(i)) for i in range(n)]


def once(value: Column, f) -> Column:
    """``f(value)`` with ``value`` worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def qvec_to_rotmat(q: Column) -> Column:
    """3x3 of a quaternion (w, x, y, z), which is not normalised first."""
    w, x, y, z = items(q, 4)
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


def normalized(v: Column, n: int) -> Column:
    parts = items(v, n)
    return F.array(*[x / F.sqrt(_dot(parts, parts)) for x in parts])


def quat_to_rotmat_normalized(q: Column) -> Column:
    return once(normalized(q, 4), qvec_to_rotmat)


def fov_to_focal(fov: Column, pixels: Column) -> Column:
    return pixels / (2 * F.tan(fov / 2))


def focal_to_fov(focal: Column, pixels: Column) -> Column:
    return 2 * F.atan(pixels / (2 * focal))


def fovy_from_fovx(fovx: Column, width: Column, height: Column) -> Column:
    return focal_to_fov(fov_to_focal(fovx, width), height)


#: Models whose images are free of distortion, with the places of the two focal lengths among their parameters.
FOCALS = {"SIMPLE_PINHOLE": (0, 0), "PINHOLE": (0, 1)}


def camera_fov(model: Column, params: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """(fovx, fovy); an unsupported model is an error, so filter with ``supported_cameras`` before."""
    out = []
    for axis, pixels in enumerate((width, height)):
        chosen = F.raise_error(F.concat(F.lit("camera model without undistorted images: "), model)).cast("double")
        for name, places in FOCALS.items():
            chosen = F.when(model == name, focal_to_fov(F.get(params, F.lit(places[axis])), pixels)).otherwise(chosen)
        out.append(chosen)
    return out[0], out[1]


def camera_center(rot: Column, t: Column) -> Column:
    """-R^T t."""
    r, v = items(rot, 9), items(t, 3)
    return F.array(*[-_dot([r[k], r[3 + k], r[6 + k]], v) for k in range(3)])


def world_to_view(rot: Column, t: Column, translate: Column | None = None, scale: Column | float = 1.0) -> Column:
    """4x4 of the rigid transform; with ``translate`` and ``scale`` the camera's centre is moved to (c + translate) * scale first."""
    r = items(rot, 9)
    if translate is None:
        v = items(t, 3)
    else:
        centre = [(c + s) * scale for c, s in zip(items(camera_center(rot, t), 3), items(translate, 3), strict=True)]
        v = [-_dot(r[3 * k : 3 * k + 3], centre) for k in range(3)]
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(*r[0:3], v[0], *r[3:6], v[1], *r[6:9], v[2], zero, zero, zero, one)


def projection_matrix(znear: float, zfar: float, fovx: Column, fovy: Column) -> Column:
    zero = F.lit(0.0)
    depth = zfar / (zfar - znear)
    return F.array(
        1 / F.tan(fovx / 2), zero, zero, zero,
        zero, 1 / F.tan(fovy / 2), zero, zero,
        zero, zero, F.lit(depth), F.lit(-znear * depth),
        zero, zero, F.lit(1.0), zero,
    )


def matmul4(a: Column, b: Column) -> Column:
    x, y = items(a, 16), items(b, 16)
    return F.array(*[_dot(x[4 * i : 4 * i + 4], [y[4 * k + j] for k in range(4)]) for i in range(4) for j in range(4)])


def transform_point(m: Column, x: Column, y: Column, z: Column, guard: float = 1e-7) -> list[Column]:
    """The point through a 4x4, divided by its last coordinate plus ``guard``."""
    p = [x, y, z, F.lit(1.0)]
    out = [_dot(items(m, 16)[4 * i : 4 * i + 4], p) for i in range(4)]
    return [F.try_divide(c, out[3] + guard) for c in out[:3]]


def camera_point(rot: Column, t: Column, x: Column, y: Column, z: Column) -> list[Column]:
    r, v = items(rot, 9), items(t, 3)
    return [_dot(r[3 * k : 3 * k + 3], [x, y, z]) + v[k] for k in range(3)]


def inverse_depth(rot: Column, t: Column, x: Column, y: Column, z: Column) -> Column:
    return F.try_divide(F.lit(1.0), camera_point(rot, t, x, y, z)[2])


def c2w_opengl_to_w2c(c2w: Column) -> tuple[Column, Column]:
    """(rotation, translation), world to camera, of a rigid camera-to-world 4x4 whose y and z axes point the other way."""
    m = items(c2w, 16)
    sign = [1.0, -1.0, -1.0]
    rot = [m[4 * k + i] * sign[i] for i in range(3) for k in range(3)]
    return F.array(*rot), F.array(*[-_dot(rot[3 * i : 3 * i + 3], [m[3], m[7], m[11]]) for i in range(3)])


def rotmat_to_qvec_udf():
    """Quaternion (w >= 0) of a 3x3: the top eigenvector of a symmetric 4x4. Spark has no eigenvectors, so batches go to NumPy."""

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        r = np.stack(rows.to_list()).reshape(-1, 3, 3)
        k = np.zeros((len(r), 4, 4))
        k[:, :3, :3] = r + r.transpose(0, 2, 1)
        k[:, range(3), range(3)] = np.stack([r[:, i, i] - r[:, (i + 1) % 3, (i + 1) % 3] - r[:, (i + 2) % 3, (i + 2) % 3] for i in range(3)], 1)
        k[:, 3, :3] = k[:, :3, 3] = np.stack([r[:, 2, 1] - r[:, 1, 2], r[:, 0, 2] - r[:, 2, 0], r[:, 1, 0] - r[:, 0, 1]], 1)
        k[:, 3, 3] = np.trace(r, axis1=1, axis2=2)
        top = np.linalg.eigh(k / 3)[1][:, :, -1]
        q = top[:, [3, 0, 1, 2]]
        return pd.Series(list(np.where(q[:, :1] < 0, -q, q)))

    return run
