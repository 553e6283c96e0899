import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sceneloom.functions import appearance as A
from sceneloom.functions import geometry as G
from sceneloom.functions import primitives as P
from sceneloom.functions import scalars as S


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def arr(values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_quaternions_come_back(spark):
    rng = np.random.default_rng(1)
    q = rng.normal(size=(50, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    rows = spark.createDataFrame([(v.tolist(),) for v in q], "q array<double>")
    got = rows.select("q", G.rotmat_to_qvec_udf()(G.qvec_to_rotmat(F.col("q"))).alias("b")).collect()
    for r in got:
        sign = 1 if r.q[0] >= 0 else -1
        assert np.allclose(np.array(r.b) * sign, r.q, atol=1e-9) and r.b[0] >= 0


def test_world_to_view_moves_the_centre(spark):
    q = np.array([0.8, 0.1, -0.5, 0.3])
    rot = G.quat_to_rotmat_normalized(arr(q))
    t = arr([1, 2, 3])
    got = one(spark, rot.alias("r"), G.camera_center(rot, t).alias("c"), G.world_to_view(rot, t, arr([1, 0, -1]), 2.0).alias("m"))
    m = np.array(got.m).reshape(4, 4)
    centre = (np.array(got.c) + [1, 0, -1]) * 2
    assert np.allclose(m @ np.append(centre, 1), [0, 0, 0, 1]) and np.allclose(np.linalg.inv(m)[:3, 3], centre)


def test_opengl_cameras(spark):
    rng = np.random.default_rng(2)
    rot, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    c2w = np.eye(4)
    c2w[:3, :3], c2w[:3, 3] = rot, [1, 2, 3]
    want = c2w.copy()
    want[:3, 1:3] *= -1
    want = np.linalg.inv(want)
    r, t = G.c2w_opengl_to_w2c(arr(c2w.ravel()))
    got = one(spark, r.alias("r"), t.alias("t"))
    assert np.allclose(np.reshape(got.r, (3, 3)), want[:3, :3]) and np.allclose(got.t, want[:3, 3])


def test_unsupported_camera_is_an_error(spark):
    fov, _ = G.camera_fov(F.lit("OPENCV"), arr([1, 1]), F.lit(10), F.lit(10))
    with pytest.raises(Exception, match="without undistorted"):
        one(spark, fov)


def test_harmonics_are_orthonormal():
    rng = np.random.default_rng(3)
    d = rng.normal(size=(400_000, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    basis = np.stack([np.broadcast_to(b, len(d)) for b in A.sh_basis(4, *d.T)])
    gram = basis @ basis.T / len(d) * 4 * math.pi
    assert np.allclose(gram, np.eye(25), atol=0.03)


def test_harmonic_signs():
    x, y, z = 0.36, 0.48, 0.8
    b = A.sh_basis(2, x, y, z)
    assert np.allclose(b[1:4], np.sqrt(3 / (4 * math.pi)) * np.array([-y, z, -x]))
    assert np.allclose(b[4], math.sqrt(15 / (4 * math.pi)) * x * y)
    with pytest.raises(ValueError):
        A.sh_basis(5, x, y, z)


def test_colour_comes_back_and_logit_is_finite(spark):
    got = one(spark, A.sh_to_rgb(A.rgb_to_sh(F.lit(0.3))).alias("c"), A.logit(F.lit(0.0)).alias("a"), A.logit(F.lit(1.0)).alias("b"), A.sigmoid(A.logit(F.lit(0.2))).alias("s"))
    assert abs(got.c - 0.3) < 1e-12 and math.isfinite(got.a) and math.isfinite(got.b) and abs(got.s - 0.2) < 1e-12


def test_covariance(spark):
    s, q = np.array([0.5, 2.0, 1.0]), np.array([0.9, 0.2, -0.3, 0.4])
    c = one(spark, P.covariance6(arr(s), arr(q)).alias("c")).c
    full = np.array([[c[0], c[1], c[2]], [c[1], c[3], c[4]], [c[2], c[4], c[5]]])
    assert np.isclose(np.trace(full), (s**2).sum()) and np.allclose(sorted(np.linalg.eigvalsh(full)), sorted(s**2))


@pytest.mark.parametrize(("name", "stem"), [("a.b.png", "a.b"), ("plain", ""), (".x", ""), ("a\n.jpg", "a\n")])
def test_stem(spark, name, stem):
    assert one(spark, S.image_stem(F.lit(name)).alias("s")).s == stem


def test_resolution_rounds_halves_to_even(spark):
    w, h = S.working_resolution(F.lit(5), F.lit(7), 2)
    cap = S.working_resolution(F.lit(3201), F.lit(999), -1)
    assert tuple(one(spark, w.alias("w"), h.alias("h"))) == (2, 4)
    assert tuple(one(spark, *[c.alias(n) for n, c in zip("wh", cap, strict=True)])) == (1600, 499)


def test_decay_schedule_and_affine(spark):
    got = one(
        spark,
        S.expon_decay(F.lit(-1), 1.0, 0.1).alias("before"),
        S.expon_decay(F.lit(0), 1.0, 0.1, steps=100).alias("first"),
        S.expon_decay(F.lit(100), 1.0, 0.1, steps=100).alias("last"),
        S.expon_decay(F.lit(5), 0.0, 0.0).alias("none"),
        S.apply_depth_affine(F.lit(-2.0), F.lit(0.5), F.lit(1.0)).alias("neg"),
        S.apply_depth_affine(F.lit(2.0), F.lit(0.0), F.lit(1.0)).alias("plain"),
        S.densify_schedule(F.lit(500), white=True)["reset"].alias("white"),
    )
    assert (got.before, got.none, got.neg, got.plain, got.white) == (0.0, 0.0, 1.0, 2.0, True)
    assert abs(got.first - 1) < 1e-12 and abs(got["last"] - 0.1) < 1e-12
