import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sceneloom.functions.appearance import logit, view_color
from sceneloom.jobs.scratch import keeper
from sceneloom.operators import adapt, depth, knn, metrics, project, regions, views


def brute_knn(xyz, k=3):
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    d = np.sort(d, 1)[:, :k]
    return [max(float(r[np.isfinite(r)].mean()) if np.isfinite(r).any() else 0.0, 1e-7) for r in d]


@pytest.mark.parametrize(("leaf", "block"), [(512, 2048), (20, 7)])
def test_neighbours_equal_brute_force(spark, leaf, block):
    rng = np.random.default_rng(5)
    cluster = rng.normal(size=(150, 3)) * 0.01
    xyz = np.concatenate([rng.uniform(-5, 5, (150, 3)), cluster, cluster[:9], np.repeat(cluster[:1], 6, 0), [[500, 0, 0], [500, 0, 1]]])
    scenes = [(0, xyz), (1, xyz[:1]), (2, xyz[:3]), (3, np.repeat(xyz[:1], 5, 0))]
    rows = [(s, i, *map(float, p)) for s, pts in scenes for i, p in enumerate(pts)]
    points = spark.createDataFrame(rows, "scene_id int, point3d_id long, x double, y double, z double").repartition(5)
    got = {(r.scene_id, r.point3d_id): r.mean_sq_dist for r in knn.nearest_sq_dist(points, keeper(spark, "t"), leaf=leaf, block=block).collect()}
    assert len(got) == len(rows)
    for s, pts in scenes:
        assert np.allclose([got[s, i] for i in range(len(pts))], brute_knn(pts), rtol=1e-9)


def test_regions_follow_density(spark):
    """A far point, tight clusters and points on a line need no more visits, and no larger regions, than even points."""
    rng = np.random.default_rng(3)
    even = rng.uniform(-5, 5, (4000, 3))
    clusters = np.concatenate([c + rng.normal(size=(500, 3)) * 10.0**-k for k, c in enumerate(rng.uniform(-5, 5, (8, 3)))])
    line = np.stack([np.exp(rng.uniform(-20, 5, 4000)), np.zeros(4000), np.zeros(4000)], 1)
    far = np.concatenate([even[1:], [[1e9, -1e9, 1e9]]])
    visits = []
    for xyz in (even, far, clusters, line):
        points = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(xyz)], "scene_id int, place long, x double, y double, z double")
        found = regions.split(points, keeper(spark, "t"), ["scene_id"], ["x", "y", "z"], ["place"], 100)
        assert found.rows.count() == 4000 and found.rows.groupBy("region").count().agg(F.max("count")).first()[0] <= 100
        d = np.sort(((xyz[:, None] - xyz[None]) ** 2).sum(2), 1)[:, 3]
        asking = spark.createDataFrame([(0, *map(float, p), float(np.sqrt(r))) for p, r in zip(xyz, d, strict=True)], "scene_id int, x double, y double, z double, reach double")
        visits.append(regions.reached(found, asking, ["x", "y", "z"], "reach").count())
    # The far point may ask many regions, the others no more than they did.
    assert visits[1] <= 1.2 * visits[0] + 200 and visits[2] <= 1.5 * visits[0] and visits[3] <= visits[0]


def test_ssim():
    rng = np.random.default_rng(6)
    a, b = rng.uniform(size=(2, 3, 20, 16)), rng.uniform(size=(2, 3, 20, 16))
    assert np.allclose(metrics.ssim_images(a, a), 1)
    at = np.arange(11) - 5
    g = np.exp(-(at**2) / 4.5)
    w = np.outer(g, g) / g.sum() ** 2
    blur = lambda x: np.array([[(np.pad(x, 5)[i : i + 11, j : j + 11] * w).sum() for j in range(16)] for i in range(20)])
    vals = []
    for x, y in zip(a[0], b[0], strict=True):
        mx, my = blur(x), blur(y)
        vals.append(((2 * mx * my + 1e-4) * (2 * (blur(x * y) - mx * my) + 9e-4) / ((mx**2 + my**2 + 1e-4) * (blur(x * x) - mx**2 + blur(y * y) - my**2 + 9e-4))).mean())
    assert np.isclose(metrics.ssim_images(a, b)[0], np.mean(vals))


def test_two_psnrs_and_exact_copies(spark):
    a, b = [0.0, 0.5, 1.0, 1.0], [0.1, 0.5, 1.0, 0.8]
    row = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    got = row.select(metrics.psnr_image(F.col("a"), F.col("b")).alias("i"), metrics.psnr_channel_mean(F.col("a"), F.col("b"), 2, 2).alias("c"), metrics.psnr_image(F.col("a"), F.col("a")).alias("x")).first()
    assert np.isclose(got.i, -10 * np.log10(0.05 / 4)) and np.isclose(got.c, (-10 * np.log10(0.01 / 2) - 10 * np.log10(0.04 / 2)) / 2) and got.x == float("inf")


PRIMS = "scene_id int, prim_id long, x double, y double, z double, f_dc array<double>, f_rest array<double>, opacity double, scale array<double>, rot array<double>"


def prims(spark, rows):
    base = [(0, i, 0.0, 0.0, 0.0, [0.0] * 3, [0.0] * 45, p, [float(np.log(s))] * 3, [1.0, 0.0, 0.0, 0.0]) for i, (p, s) in enumerate(rows)]
    return spark.createDataFrame(base, PRIMS)


def test_clones_split_and_prune(spark):
    rows = prims(spark, [(0.0, 0.01), (0.0, 1.0), (-9.0, 0.01), (0.0, 0.01), (0.0, 9.0)])
    stats = spark.createDataFrame([(0, 0, 1.0, 1, 3), (0, 1, 1.0, 1, 30), (0, 2, 1.0, 1, 3), (0, 4, 0.0, 0, 0)], "scene_id int, prim_id long, grad_sum double, denom long, max_radius long")
    got = adapt.densify_and_prune(rows, stats, extent=5.0, threshold=0.5, jitter=0.0, size_rule=False).collect()
    kinds = sorted((r.parent, r.kind, r.child) for r in got)
    # 0 is cloned, 1 is split in two, 2 and its clone are pruned, 3 and 4 were never seen.
    assert kinds == [(0, "clone", 0), (0, "own", 0), (1, "split", 1), (1, "split", 2), (3, "own", 0), (4, "own", 0)]
    assert all(np.isclose(np.exp(r.scale[0]), 1 / 1.6) for r in got if r.kind == "split")
    assert len({r.prim_id for r in got}) == 6
    sized = adapt.densify_and_prune(rows, stats, extent=5.0, threshold=0.5, jitter=0.0)
    assert sorted((r.parent, r.kind) for r in sized.collect()) == [(0, "clone"), (0, "own"), (3, "own")]
    screen = adapt.densify_and_prune(rows, stats, extent=5.0, threshold=0.5, jitter=0.0, size_rule=False, max_screen_size=2)
    assert (0, "own") not in {(r.parent, r.kind) for r in screen.collect()}


def test_jitter_follows_the_shape_and_repeats(spark):
    rows = prims(spark, [(0.0, 1.0)] * 2000)
    stats = rows.select("scene_id", "prim_id", F.lit(1.0).alias("grad_sum"), F.lit(1).alias("denom"), F.lit(1).alias("max_radius"))
    draw = lambda n: adapt.densify_and_prune(rows.repartition(n), stats, 50.0, 0.5, seed=3).select("parent", "child", "x", "y", "z").toPandas().sort_values(["parent", "child"]).reset_index(drop=True)
    a = draw(1)
    pd.testing.assert_frame_equal(a, draw(7))
    xyz = a[["x", "y", "z"]].to_numpy()
    assert np.allclose(xyz.mean(0), 0, atol=0.08) and np.allclose(xyz.std(0), 1, atol=0.06) and abs(np.corrcoef(xyz.T)[0, 1]) < 0.06


def test_reset_keeps_lower_opacities(spark):
    got = spark.createDataFrame([(0.001,), (0.9,)], "p double").select(adapt.reset_opacity(logit(F.col("p"))).alias("o")).collect()
    assert np.allclose([1 / (1 + np.exp(-r.o)) for r in got], [0.001, 0.01])


def test_depth_fit_recovers_an_affine_map(spark):
    rng = np.random.default_rng(7)
    mono = rng.uniform(0.1, 1, 200)
    rows = [(0, 1, float(2 * m + 0.5), float(m), True) for m in mono]
    rows += [(0, 2, 1.0, 0.5, True)] * 30 + [(0, 3, float(m), 0.5, True) for m in mono] + [(0, 4, float(m), float(m), i < 10) for i, m in enumerate(mono)] + [(0, 5, float(i), float(i), i == 0) for i in range(20)]
    got = {r.image_id: (r.scale, r.offset) for r in depth.fit_depth_scale(spark.createDataFrame(rows, depth._SAMPLED)).collect()}
    assert np.allclose(got[1], (2, 0.5)) and all(got[k] == (0.0, 0.0) for k in (2, 3, 4, 5))


def test_bilinear_keeps_the_border():
    grid = np.array([[0.0, 1.0], [2.0, 3.0]])
    assert np.allclose(depth.bilinear(grid, np.array([0.5, -3, 9]), np.array([0.5, 0, 9])), [1.5, 0, 3])


def test_reliability(spark):
    rows = spark.createDataFrame([(None, 1.0), (0.0, 1.0), (0.2, 1.0), (5.1, 1.0), (0.0, 0.0)], "s double, m double")
    assert [r[0] for r in rows.select(depth.reliable_depth(F.col("s"), F.col("m"))).collect()] == [True, False, True, False, True]


def test_holdout_and_samples(spark):
    rows = spark.createDataFrame([(s, f"{i:02d}") for s in (0, 1) for i in range(10 if s else 3)], "scene_id int, name string")
    assert rows.count() == views.holdout_split(rows, hold=None).filter("is_train and not is_test").count()
    both = views.holdout_split(rows, train_test_exp=True)
    assert both.filter("is_train and is_test").count() == 3
    got = sorted((r.scene_id, r.place, r.name) for r in views.validation_sample(rows).collect())
    assert got == sorted((s, p, f"{p % n:02d}") for s, n in ((0, 3), (1, 10)) for p in (5, 10, 15, 20, 25))
    epochs = views.epoch_sampler(rows, 4).collect()
    assert all(sorted(r.name for r in epochs if (r.scene_id, r.epoch) == (1, e)) == [f"{i:02d}" for i in range(10)] for e in range(4))
    paths = spark.createDataFrame([("a", "a/iteration_7000/x"), ("a", "a/iteration_30000/x"), ("a", "a/other/x")], "scene_id string, path string")
    assert views.latest_iteration(paths).first().iteration == 30000


def test_partitions_dont_matter(spark):
    rng = np.random.default_rng(8)
    rows = [(0, int(i % 5), int(i % 40), int(rng.integers(0, 4)), float(rng.uniform()), float(rng.uniform())) for i in range(500)]
    df = spark.createDataFrame(rows, "scene_id int, view_id int, prim_id int, radius int, grad_x double, grad_y double")
    out = [sorted(map(lambda r: (r.prim_id, round(r.grad_sum, 9), r.denom, r.max_radius), adapt.accumulate_prim_stats(df.repartition(n)).collect())) for n in (1, 4, 37)]
    assert out[0] == out[1] == out[2]


def test_random_cloud(spark):
    a, b = (adapt.random_point_cloud(spark, 3000, seed=2).repartition(n).orderBy("point3d_id").toPandas() for n in (1, 5))
    pd.testing.assert_frame_equal(a, b)
    assert a[["x", "y", "z"]].abs().max().max() <= 1.3 and abs(a.x.mean()) < 0.06


def test_ema_of_a_small_share_reaches_far(spark):
    rows = spark.range(400).selectExpr("1L as series", "id as ts", "id as event_id", "if(id < 200, 5d, 1d) as loss")
    want, got = 0.0, {r.event_id: r.ema for r in metrics.ema(rows, 0.01).collect()}
    for i in range(400):
        want = 0.99 * want + 0.01 * (5.0 if i < 200 else 1.0)
        assert abs(got[i] - want) < 1e-9


def test_knn_sets_odd_points_apart(spark):
    rng = np.random.default_rng(3)
    xyz = rng.normal(size=(20, 3))
    rows = [(1, i, *map(float, p)) for i, p in enumerate(xyz)]
    odd = [(1, 100, float("nan"), 0.0, 0.0), (1, 101, 0.0, float("inf"), 0.0), (1, 102, 0.0, 0.0, None), (2, 1, float("-inf"), 1.0, 1.0)]
    points = spark.createDataFrame(rows + odd, "scene_id int, point3d_id long, x double, y double, z double")
    got = {(r.scene_id, r.point3d_id): r.mean_sq_dist for r in knn.nearest_sq_dist(points, keeper(spark, "t")).collect()}
    assert {k for k, v in got.items() if v is None} == {(1, 100), (1, 101), (1, 102), (2, 1)}
    assert np.allclose([got[1, i] for i in range(20)], brute_knn(xyz), rtol=1e-9)


def test_composite_gives_every_pixel(spark):
    rows = [(1, 1, 0, 2.0, 7, 0.5, 1.0, 0.0, 0.0), (1, 1, 1, 1.0, 7, 0.001, 1.0, 1.0, 1.0)]
    fragments = spark.createDataFrame(rows, "scene_id int, view_id int, pixel int, depth double, prim_id long, alpha double, red double, green double, blue double")
    pixels = spark.createDataFrame([(1, 1, p) for p in range(3)], "scene_id int, view_id int, pixel int")
    out = {r.pixel: r for r in metrics.composite(fragments, 0.25, pixels=pixels).collect()}
    assert (out[0].red, out[0].transmittance, out[0].n_blended) == (0.625, 0.5, 1)
    assert all((out[p].red, out[p].transmittance, out[p].n_blended, out[p].inverse_depth) == (0.25, 1.0, 0, 0.0) for p in (1, 2))
    assert {r.pixel for r in metrics.composite(fragments).collect()} == {0, 1}


def test_running_mean_of_a_small_share(spark):
    rows = spark.createDataFrame([(1, i, i, 1.0) for i in range(1000)], "series int, ts int, event_id int, loss double")
    last = metrics.ema(rows, 0.01).filter("event_id = 999").first().ema
    assert abs(last - (1 - 0.99**1000)) < 1e-9


def test_render_blends_splats_and_leaves_the_rest_background(spark):
    identity, turn = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [1.0, 0.0, 0.0, 0.0]
    fov = 2 * math.atan(0.5)
    views = spark.createDataFrame([(0, v, identity, [0.0, 0.0, 0.0], fov, fov, 20, 20) for v in (1, 2)] + [(1, 3, identity, [0.0, 0.0, 0.0], fov, fov, 5, 3)], "scene_id int, view_id int, view_rot array<double>, tvec array<double>, fovx double, fovy double, width int, height int")
    # Two before the camera, the nearer one listed last; one behind it; one without opacity.
    prims = [(0, 1, 0.0, 0.0, 4.0, 0.9, 0.5), (0, 2, 0.0, 0.0, 2.0, 0.8, 1.0), (0, 3, 0.0, 0.0, -2.0, 0.9, 1.0), (0, 4, 0.0, 0.0, 1.0, 0.0, 1.0)]
    rows = spark.createDataFrame([(s, p, x, y, z, [0.05] * 3, turn, o, c, c, c) for s, p, x, y, z, o, c in prims], "scene_id int, prim_id long, x double, y double, z double, scale array<double>, rot array<double>, opacity double, red double, green double, blue double")
    got = {(r.view_id, r.pixel): r for r in project.render(rows, views, keeper(spark, "t"), 0.25, tile=8, override=[F.col(c) for c in ("red", "green", "blue")]).collect()}
    assert len(got) == 2 * 400 + 15

    def alpha(opacity, depth, x, y):
        spread = (20 / depth * 0.05) ** 2 + 0.3
        return opacity * math.exp(-((x + 0.5 - 10) ** 2 + (y + 0.5 - 10) ** 2) / (2 * spread))

    for (view, pixel), row in got.items():
        through, red, n = 1.0, 0.0, 0
        for opacity, depth, c in [(0.8, 2.0, 1.0), (0.9, 4.0, 0.5)] if view < 3 else []:
            a = alpha(opacity, depth, pixel % 20, pixel // 20)
            # Only tiles that the square of three deviations touches: all four around the centre.
            if a >= 1 / 255:
                red, through, n = red + through * a * c, through * (1 - a), n + 1
        assert (row.n_blended, row.red, row.transmittance) == (n, pytest.approx(red + 0.25 * through), pytest.approx(through))
    assert got[1, 9 * 20 + 9].n_blended == 2 and got[3, 0].red == 0.25
    assert project.render(rows.limit(0), views, keeper(spark, "t"), 0.25, override=[F.col(c) for c in ("red", "green", "blue")]).filter("red = 0.25").count() == 815


def many_splats(spark, n=400, seed=4):
    """Primitives all around, most of them unseen, and cameras in their midst and outside."""
    rng = np.random.default_rng(seed)
    rows = [(int(k % 2), k, *map(float, rng.uniform(-12, 12, 3)), [float(v) for v in np.exp(rng.uniform(-4, 0.5, 3))], [float(v) for v in rng.normal(size=4)], float(rng.uniform(0, 1)), [float(v) for v in rng.normal(size=3)], [float(v) for v in rng.normal(size=9) / 4]) for k in range(n)]
    rows += [(0, n + 1, float("nan"), 0.0, 1.0, [1.0] * 3, [1.0, 0.0, 0.0, 0.0], 0.5, [0.0] * 3, [0.0] * 9), (0, n + 2, 0.0, 0.0, None, [1.0] * 3, [1.0, 0.0, 0.0, 0.0], 0.5, [0.0] * 3, [0.0] * 9)]
    prims = spark.createDataFrame(rows, "scene_id int, prim_id long, x double, y double, z double, scale array<double>, rot array<double>, opacity double, f_dc array<double>, f_rest array<double>")
    cams = []
    for v in range(6):
        turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        turn *= np.sign(np.linalg.det(turn))
        at = rng.uniform(-3, 3, 3) * (v + 1) / 2
        cams.append((v % 2, v, [float(x) for x in turn.ravel()], [float(x) for x in -turn @ at], [float(x) for x in at], 0.5, 0.4, 37, 26))
    return prims, spark.createDataFrame(cams, "scene_id int, view_id long, view_rot array<double>, tvec array<double>, centre array<double>, fovx double, fovy double, width long, height long")


def test_culled_cells_hide_nothing(spark, monkeypatch):
    prims, views = many_splats(spark)
    prims, views = keeper(spark, "t")(prims, "prims"), keeper(spark, "t")(views, "views")
    seen = lambda cell: sorted((r.view_id, r.prim_id, round(r.px, 6), r.radius) for r in project.project(prims, views, keeper(spark, "t"), 8, cell).collect())
    _, boxes = project.cells(prims, keeper(spark, "t"), 4)
    pairs = boxes.join(views, "scene_id")
    met = pairs.filter(project.may_be_seen(8)).agg(F.sum("n")).first()[0]
    few, one = seen(4), seen(1000)
    monkeypatch.setattr(project, "may_be_seen", lambda margin: F.lit(True))
    assert few == one == seen(1000) and len(few) > 40
    assert len(few) <= met < 0.6 * prims.count() * 3


@pytest.mark.parametrize("held", [project.HELD, 1])
def test_counts_of_tiles_equal_their_rows(spark, held, monkeypatch):
    """Counted in blocks, or row by row; no pair of a primitive and a view is shuffled or written."""
    monkeypatch.setattr(project, "HELD", held)
    prims, views = many_splats(spark)
    prims, views, written = keeper(spark, "t")(prims, "prims"), keeper(spark, "t")(views, "views"), []

    def keep(df, name):
        written.append(keeper(spark, "t")(df, name))
        return written[-1]

    rows = project.assign_tiles(project.project(prims, views, keep, 8, 50), 8).groupBy(*project.KEY).count()
    got = {tuple(r) for r in project.tile_counts(prims, views, keep, 8, 50).collect()}
    assert got == {tuple(r) for r in rows.select(*project.KEY, "count").collect()} and len(got) > 50
    assert not any({"prim_id", "view_id"} <= {*df.columns} for df in written)
    assert all(df.count() <= prims.count() for df in written)


def test_cuts_come_from_sampled_primitives_alone(spark):
    """What the sample of the primitives makes is the sample of what all make."""
    prims, views = many_splats(spark, 150)
    prims, views = keeper(spark, "t")(prims, "prims"), keeper(spark, "t")(views, "views")
    made = lambda rows: project.assign_tiles(project.project(rows, views, keeper(spark, "t"), 8), 8)
    some = lambda df: {tuple(r) for r in df.select(*project.KEY, "prim_id").collect()}
    tiled = keeper(spark, "t")(made(prims), "tiled")
    drawn = some(made(project.sampled(prims, 48)))
    assert drawn == some(project.sampled(tiled, 48)) and 0 < len(drawn) < tiled.count()


@pytest.mark.parametrize("cell", [4, 1000])
def test_all_before_the_camera_are_projected_without_a_margin(spark, cell):
    """On the frame or not, whatever the cells; what a pose without a number leaves open is null."""
    prims, views = many_splats(spark)
    views = views.withColumn("tvec", F.when(F.col("view_id") == 5, F.array(F.lit(None).cast("double"), F.get("tvec", F.lit(1)), F.get("tvec", F.lit(2)))).otherwise(F.col("tvec")))
    prims, views = keeper(spark, "t")(prims, "prims"), keeper(spark, "t")(views, "views")
    got = {(r.view_id, r.prim_id): r for r in project.project(prims, views, keeper(spark, "t"), None, cell).collect()}
    known, want = prims.filter("NOT isnan(x) AND z IS NOT NULL").collect(), {}
    for v in views.collect():
        (fx, fy), t = (v.width / 2 / math.tan(v.fovx / 2), v.height / 2 / math.tan(v.fovy / 2)), np.array(v.tvec, float)
        for p in known:
            c = np.reshape(v.view_rot, (3, 3)) @ [p.x, p.y, p.z] + t
            if p.scene_id == v.scene_id and c[2] > project.NEAR:
                want[v.view_id, p.prim_id] = None if np.isnan(c[0]) else fx * c[0] / c[2] + v.width / 2, fy * c[1] / c[2] + v.height / 2, c[2]
    assert got.keys() == want.keys() and {v for v, _ in got} == set(range(6))
    assert all((r.px, r.py, r.depth) == pytest.approx(want[k]) for k, r in got.items())
    assert all((r.radius is None) == (r.view_id == 5) and (r.radius or 2) > 0 for r in got.values())
    framed = {(r.view_id, r.prim_id): (r.px, r.radius, r.conic) for r in project.project(prims, views, keeper(spark, "t"), 0, cell).collect()}
    assert 0 < len(framed) < len(got) and all(framed[k] == (got[k].px, got[k].radius, got[k].conic) for k in framed)


@pytest.mark.parametrize("most", [4096, 6])
def test_tiles_blended_as_blocks_equal_fragments(spark, most):
    """By harmonics and by given colours, with tiles whole and cut by depth; some splats stand at one depth."""
    prims, views = many_splats(spark, 150)
    prims = prims.withColumn("z", F.when(F.col("prim_id") % 5 == 0, F.lit(2.0)).otherwise(F.col("z")))
    prims, views = keeper(spark, "t")(prims, "prims"), keeper(spark, "t")(views, "views")
    got = project.render(prims, views, keeper(spark, "t"), 0.3, tile=8, degree=1, most_splats=most)
    keyed = lambda df: {(r.view_id, r.pixel): (r.red, r.green, r.blue, r.inverse_depth, r.transmittance, r.n_blended) for r in df.collect()}
    rgb = view_color(1, F.col("f_dc"), F.col("f_rest"), [F.col(a) for a in "xyz"], [F.get("centre", F.lit(k)) for k in range(3)], 3)
    splats = project.project(prims, views, keeper(spark, "t"), 8).withColumns(dict(zip(("red", "green", "blue"), rgb, strict=True)))
    want = keyed(project.render_by_pixels(project.assign_tiles(splats, 8), views, 0.3, 8))
    got = keyed(got)
    assert got.keys() == want.keys() and len(got) == 6 * 37 * 26
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in got) and sum(w[5] > 3 for w in want.values()) > 100
    tiled = keeper(spark, "t")(project.assign_tiles(splats, 8), "tiled")
    ranked = project.depth_ranked(tiled, keeper(spark, "t"), most=most).toPandas().sort_values(["view_id", "tile_x", "tile_y", "depth", "prim_id"])
    assert (ranked.groupby(["view_id", "tile_x", "tile_y"]).cumcount() == ranked["rank"]).all()
    if most == 6:
        parts = project.depth_parts(tiled, keeper(spark, "t"), most=6)
        assert parts.groupBy(*project.KEY, "part").count().agg(F.max("count")).first()[0] <= 7 and parts.agg(F.max("parts")).first()[0] > 1


def test_activations_of_the_callers_choice(spark):
    from sceneloom.functions import primitives as P

    row = spark.createDataFrame([(0.25, [1.0, 2.0, 3.0], [0.0, 2.0, 0.0, 0.0])], "opacity double, scale array<double>, rot array<double>")
    got = P.activate(F.col("opacity"), F.col("scale"), F.col("rot"), opacity_of=lambda x: x * 2, scale_of=lambda x: x + 1)
    out = row.select(*[v.alias(k) for k, v in got.items()]).first()
    assert (out.opacity, out.scale, out.rot) == (0.5, [2.0, 3.0, 4.0], [0.0, 1.0, 0.0, 0.0])


def test_ema_of_one_long_series_over_many_tasks(spark):
    """Some nulls; a second series; parts join as one pass would."""
    rows = spark.range(20_000).selectExpr("1L AS series", "timestamp_seconds(id) AS ts", "id AS event_id", "if(id % 7 = 3, null, double(id * 37 % 101)) AS loss")
    rows = rows.unionByName(spark.createDataFrame([(0, None, 1, 2.0)], "series long, ts timestamp, event_id long, loss double"))
    got = metrics.ema(rows.repartition(3), 0.003).orderBy("series", "event_id").collect()
    assert len(got) == 20_001 and got[0].ema == 0.003 * 2.0
    value = 0.0
    for r in got[1:]:
        value = value if r.loss is None else 0.997 * value + 0.003 * r.loss
        assert abs(r.ema - value) < 1e-9
    assert [r.ema for r in metrics.ema(rows.limit(0), 0.1).collect()] == []


def test_ssim_by_tiles_equals_whole_images(spark):
    rng = np.random.default_rng(8)
    a, b = rng.uniform(size=(2, 2, 3, 33, 21))
    images = spark.createDataFrame([(str(k), a[k].ravel().tolist(), b[k].ravel().tolist()) for k in range(2)], "image string, a array<double>, b array<double>")
    want = metrics.ssim_images(a, b)
    for tile in (3, 8, 64):
        got = {r.image: r.ssim for r in metrics.ssim_by_tiles(metrics.cut_tiles(images, 3, 33, 21, tile), tile).collect()}
        assert np.allclose([got["0"], got["1"]], want, atol=1e-12)


def test_resized_by_area(spark):
    from sceneloom.functions import scalars as S

    rng = np.random.default_rng(9)
    image = rng.uniform(size=(2, 7, 10))
    rows = spark.createDataFrame([(image.ravel().tolist(), 7, 10, h, w) for h, w in ((3, 4), (7, 10), (14, 20), (1, 1))] + [(None, 7, 10, 1, 1)], "v array<double>, h int, w int, th int, tw int")
    got = [r[0] for r in rows.select(S.resized(F.col("v"), F.col("h"), F.col("w"), F.col("th"), F.col("tw"))).collect()]
    # Against cells cut so finely that both sizes divide them.
    fine = np.repeat(np.repeat(image, 3, 1), 4, 2)
    assert np.allclose(np.reshape(got[0], (2, 3, 4)), fine.reshape(2, 3, 7, 4, 10).mean((2, 4)))
    assert np.allclose(got[1], image.ravel()) and np.allclose(np.reshape(got[2], (2, 14, 20)), np.repeat(np.repeat(image, 2, 1), 2, 2))
    assert np.allclose(got[3], image.mean((1, 2))) and got[4] is None


def test_small_counts_rows_and_bytes(spark):
    rows = spark.range(100).selectExpr("id", "repeat('x', 1000) AS wide")
    hinted = lambda df: "ResolvedHint (strategy=broadcast)" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(views.small(rows)) and not hinted(views.small(rows, most=99)) and not hinted(views.small(rows, most_bytes=50_000))
