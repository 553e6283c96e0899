"""Scene tables written to files and read back, with SQL over what was written.

Files go to a new folder under the shared checkpoint folder, which all
executors have to mount.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import metrics
from ..sinks import files as sinks
from ..sinks.records import PlacedBytes
from ..sources import calibration, files, scenes
from . import fixtures as X
from .fixtures import with_views
from .queries import _MED, _PARAMS, _SCORED, depth_params, finite, pairs, r, scored, with_pairs, with_seen
from .scratch import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _scene(path: str = "path"):
    """The scene's folder, whose name is its number."""
    return F.regexp_extract(path, r"/(\d+)/[^/]+$", 1).cast("int").alias("scene_id")


def model(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cameras, images and points with what the files hold besides."""
    scene = F.col("scene_id").cast("string").alias("scene_id")
    f = [F.get("params", F.lit(k)) for k in range(2)]
    centre = [F.col("width") / 2, F.col("height") / 2]
    params = F.when(F.col("model") == "SIMPLE_PINHOLE", F.array(f[0], *centre)).when(F.col("model") == "PINHOLE", F.array(*f, *centre)).otherwise(F.array(*f, *centre, *[F.lit(v) for v in (0.1, 0.2, 0.3, 0.4)]))
    cameras = X.cameras(spark, sf).select(scene, F.col("camera_id").cast("int").alias("camera_id"), "model", "width", "height", params.alias("params"))
    seen = X.observations(spark, sf)
    points2d = seen.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("idx", "x", "y", "point3d_id"))).alias("p"))
    images = X.images(spark, sf).join(points2d, "image_id", "left")
    listed = F.transform(F.coalesce("p", F.array().cast("array<struct<idx:int,x:double,y:double,point3d_id:long>>")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["point3d_id"].alias("point3d_id")))
    images = images.select(scene, F.col("image_id").cast("int").alias("image_id"), "qvec", "tvec", F.col("camera_id").cast("int").alias("camera_id"), "name", listed.alias("points2d"))
    tracks = seen.filter("point3d_id >= 0").groupBy("scene_id", "point3d_id").agg(F.sort_array(F.collect_list(F.struct(F.col("image_id").cast("int").alias("image_id"), F.col("idx").cast("int").alias("point2d_idx")))).alias("track"))
    points = X.points3d(spark, sf).join(tracks, ["scene_id", "point3d_id"], "left")
    points = points.select(scene, "point3d_id", "x", "y", "z", "r", "g", "b", "error", F.coalesce("track", F.array().cast("array<struct<image_id:int,point2d_idx:int>>")).alias("track"))
    return cameras, images, points


def both(spark: SparkSession, sf: str, part: int, read: Callable[[SparkSession, str, str], DataFrame]) -> DataFrame:
    """One table of the model by way of its binary file and of its text file; the others are written empty."""
    out = None
    for ext in ("bin", "txt"):
        root = shared_folder(spark, f"model-{ext}")
        tables = [t if k == part else t.limit(0) for k, t in enumerate(model(spark, sf))]
        sinks.write_model(root, ext, *tables).collect()
        rows = read(spark, root, ext).withColumn("ext", F.lit(ext))
        out = rows if out is None else out.unionByName(rows)
    return out


_EXT = "(VALUES ('bin'), ('txt')) AS e(ext)"


@query(with_views(f"SELECT ext, scene_id, camera_id, model, width, height, round(fx, 6) + 0.0 AS fx, CASE model WHEN 'SIMPLE_PINHOLE' THEN 3 WHEN 'PINHOLE' THEN 4 ELSE 8 END AS n_params FROM cameras, {_EXT}", "cameras"))
def camera_files(spark, sf):
    rows = both(spark, sf, 0, calibration.read_cameras)
    return rows.select("ext", F.col("scene_id").cast("int").alias("scene_id"), "camera_id", "model", "width", "height", r(F.get("params", F.lit(0)), "fx"), F.size("params").alias("n_params"))


@query(with_views(f"SELECT ext, scene_id, image_id::INT AS image_id, camera_id, name, round(qx, 6) + 0.0 AS qx, round(tx, 6) + 0.0 AS tx, count(idx) AS n, coalesce(sum(point3d_id), 0)::BIGINT AS ids, round(coalesce(sum(x), 0), 4) + 0.0 AS xs FROM images LEFT JOIN observations USING (scene_id, image_id), {_EXT} GROUP BY ALL", "images", "observations"))
def image_files(spark, sf):
    rows = both(spark, sf, 1, calibration.read_images)
    total = lambda f, zero: F.aggregate("points2d", zero, lambda a, p: a + p[f])
    return rows.select("ext", F.col("scene_id").cast("int").alias("scene_id"), "image_id", "camera_id", "name", r(F.get("qvec", F.lit(1)), "qx"), r(F.get("tvec", F.lit(0)), "tx"), F.size("points2d").cast("long").alias("n"), total("point3d_id", F.lit(0).cast("long")).alias("ids"), r(total("x", F.lit(0.0)), "xs", 4))


@query(with_views(f"SELECT ext, p.scene_id, p.point3d_id, round(p.x, 6) + 0.0 AS x, round(p.y, 6) + 0.0 AS y, round(p.z, 6) + 0.0 AS z, p.r::INT AS r, p.b::INT AS b, round(error, 6) + 0.0 AS error, count(idx) AS n, coalesce(sum(o.image_id), 0)::BIGINT AS seen_by FROM points3d p LEFT JOIN observations o ON o.scene_id = p.scene_id AND o.point3d_id = p.point3d_id, {_EXT} GROUP BY ALL", "points3d", "observations"))
def point_files(spark, sf):
    rows = both(spark, sf, 2, calibration.read_points3d)
    seen_by = F.aggregate("track", F.lit(0).cast("long"), lambda a, t: a + t["image_id"])
    return rows.select("ext", F.col("scene_id").cast("int").alias("scene_id"), "point3d_id", *[r(a, a) for a in "xyz"], F.col("r").cast("int").alias("r"), F.col("b").cast("int").alias("b"), r("error", "error"), F.size("track").cast("long").alias("n"), seen_by.alias("seen_by"))


@query(with_views("SELECT scene_id, round(x::FLOAT::DOUBLE, 3) + 0.0 AS x, round(y::FLOAT::DOUBLE, 3) + 0.0 AS y, round(z::FLOAT::DOUBLE, 3) + 0.0 AS z, round(r / 255e0, 6) + 0.0 AS r, round(g / 255e0, 6) + 0.0 AS g, round(b / 255e0, 6) + 0.0 AS b FROM points3d", "points3d"))
def point_cloud_files(spark, sf):
    root = shared_folder(spark, "clouds")
    sinks.write_point_cloud_ply(X.points3d(spark, sf), root).collect()
    return files.read_point_cloud_ply(spark, root, "points3D.ply").select(_scene(), *[r(a, a, 3) for a in "xyz"], *[r(c, c) for c in "rgb"])


@query(with_views("SELECT scene_id::INT AS scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY prim_id) - 1 AS prim_id, round(x::FLOAT::DOUBLE, 3) + 0.0 AS x, round(dc1::FLOAT::DOUBLE, 3) + 0.0 AS dc1, round(rest[45]::FLOAT::DOUBLE, 3) + 0.0 AS rest44, round(ln(p / (1 - p))::FLOAT::DOUBLE, 3) + 0.0 AS opacity, round(ln(s / 4)::FLOAT::DOUBLE, 3) + 0.0 AS scale2, round(q3::FLOAT::DOUBLE, 3) + 0.0 AS q3 FROM primitives", "primitives"))
def primitive_files(spark, sf):
    root = shared_folder(spark, "primitives")
    sinks.write_primitives_ply(X.primitives(spark, sf), root, 7).collect()
    at = lambda c, k, name: r(F.get(c, F.lit(k)).cast("double"), name, 3)
    scene = F.regexp_extract("path", r"/(\d+)/point_cloud/", 1).cast("int").alias("scene_id")
    return files.read_primitives_ply(spark, root).select(scene, "prim_id", r(F.col("x").cast("double"), "x", 3), at("f_dc", 1, "dc1"), at("f_rest", 44, "rest44"), r(F.col("opacity").cast("double"), "opacity", 3), at("scale", 2, "scale2"), at("rot", 3, "q3"))


@query(with_views("SELECT scene_id, left(name, length(name) - 4) AS image_stem, round((image_id % 9 - 2) / 10e0, 6) + 0.0 AS scale, round(image_id % 5 / 10e0, 6) + 0.0 AS off FROM images WHERE image_id % 4 <> 0", "images"))
def depth_params_file(spark, sf):
    root = shared_folder(spark, "depth-params")
    rows = sinks.depth_params_json(depth_params(spark, sf))
    rows.select("scene_id", F.col("json").alias("value")).write.partitionBy("scene_id").text(root)
    back = files.read_depth_params(spark, root, "*.txt")
    scene = F.regexp_extract("path", r"scene_id=(\d+)/", 1).cast("int").alias("scene_id")
    return back.select(scene, "image_stem", r("scale", "scale"), r("offset", "off"))


@query(with_pairs("SELECT scene_id, method, round(avg(psnr), 5) + 0.0 AS psnr, round(avg(l1), 6) + 0.0 AS l1 FROM scored GROUP BY scene_id, method", scored=_SCORED))
def results_report(spark, sf):
    rows = sinks.results_json(metrics.scene_metrics(scored(spark, sf), ["l1", "psnr"]), {"PSNR": "psnr", "L1": "l1"})
    back = rows.select("scene_id", F.explode(F.from_json("json", "map<string,struct<PSNR:double,L1:double>>")).alias("method", "v"))
    return back.select("scene_id", "method", r("v.PSNR", "psnr", 5), r("v.L1", "l1"))


@query(with_pairs("SELECT scene_id, method, name, round(l1, 6) + 0.0 AS l1 FROM scored", scored=_SCORED))
def per_view_report(spark, sf):
    """Keys of the report are names behind the view's number, as names alone come again."""
    own = scored(spark, sf).withColumn("name", F.concat_ws("/", "vec_id", "name"))
    rows = sinks.per_view_json(own, {"L1": "l1"})
    back = rows.select("scene_id", F.explode(F.from_json("json", "map<string,map<string,map<string,double>>>")).alias("method", "v"))
    return back.select("scene_id", "method", F.explode(F.col("v")["L1"]).alias("name", "l1")).select("scene_id", "method", F.substring_index("name", "/", -1).alias("name"), r("l1", "l1"))


def written_model(spark: SparkSession, sf: str, ext: str = "bin") -> str:
    """The folder of a model of all scenes."""
    root = shared_folder(spark, "scenes")
    sinks.write_model(root, ext, *model(spark, sf)).collect()
    return root


@query(with_views("SELECT DISTINCT scene_id, 'bin' AS ext, 'calibrated' AS kind FROM images", "images"))
def scene_kinds(spark, sf):
    root = written_model(spark, sf)
    kinds = files.scene_types(spark, root)
    return calibration.detect_format(spark, root).join(kinds, "scene_id").select(F.col("scene_id").cast("int").alias("scene_id"), "ext", "kind")


def placed(df: DataFrame) -> None:
    """Rows (path, value) as files with these bytes."""
    df.sparkSession.dataSource.register(PlacedBytes)
    df.select("path", F.lit(0).cast("long").alias("at"), F.col("value").cast("binary").alias("data")).write.format(PlacedBytes.name()).mode("append").save()


_OPTIONAL = "SELECT seen.*, s.scale, s.off, CASE WHEN s.scale IS NOT NULL THEN med END AS med, CASE WHEN seen.image_id % 6 = 0 THEN seen.image_id / 10e0 ELSE 1e0 END AS m0 FROM seen LEFT JOIN params s USING (scene_id, image_id) LEFT JOIN med USING (scene_id)"


@query(with_seen("SELECT scene_id, name, width, height, round(fovx, 6) + 0.0 AS fovx, round(fovy, 6) + 0.0 AS fovy, round(c0, 6) + 0.0 AS c0, round(c2, 6) + 0.0 AS c2, round(scale, 6) + 0.0 AS depth_scale, round(off, 6) + 0.0 AS depth_offset, round(med, 6) + 0.0 AS med_scale, round(m0, 6) + 0.0 AS m0 FROM optional", params=_PARAMS, med=_MED, optional=_OPTIONAL))
def loaded_scenes(spark, sf):
    """Views by way of model files as text, whose camera parameters hold both focal lengths, with depth parameters of most and exposures of some."""
    root = written_model(spark, sf, "txt")
    at = lambda rest: F.concat(F.lit(f"{root}/"), F.col("scene_id").cast("string"), F.lit(rest)).alias("path")
    own = X.images(spark, sf).filter("image_id % 6 = 0").select("scene_id", F.col("name").alias("image_name"), F.array(F.col("image_id") / 10.0, *[F.lit(float(v)) for v in (0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0)]).alias("m"))
    placed(sinks.depth_params_json(depth_params(spark, sf)).select(at("/sparse/0/depth_params.json"), F.col("json").alias("value")))
    placed(sinks.exposures_json(own).select(at("/exposure.json"), F.col("json").alias("value")))
    rows = scenes.load_scene(spark, root, "calibrated", ext="txt")
    centre = lambda k: r(F.get("centre", F.lit(k)), f"c{k}")
    return rows.select(F.col("scene_id").cast("int").alias("scene_id"), "name", "width", "height", r("fovx", "fovx"), r("fovy", "fovy"), centre(0), centre(2), *[r(c, c) for c in ("depth_scale", "depth_offset", "med_scale")], r(F.get("exposure", F.lit(0)), "m0"))


def text_files(df: DataFrame, name: str) -> str:
    """Rows (scene_id, value) as text files of scene folders."""
    root = shared_folder(df.sparkSession, name)
    df.select("scene_id", "value").write.partitionBy("scene_id").text(root)
    return root


def _folder():
    return F.regexp_extract("path", r"scene_id=(\d+)/", 1).cast("int").alias("scene_id")


@query(with_views("SELECT scene_id, name AS image_name, round(image_id / 10e0, 6) + 0.0 AS m0, 2e0 AS m7, 12 AS n FROM images", "images"))
def exposure_files(spark, sf):
    m = F.array(F.col("image_id") / 10.0, *[F.lit(float(v)) for v in (0, 0, 0, 0, 1, 0, 2, 0, 0, 1, 0)])
    rows = sinks.exposures_json(X.images(spark, sf).select("scene_id", F.col("name").alias("image_name"), m.alias("m")))
    back = files.read_exposures(spark, text_files(rows.withColumnRenamed("json", "value"), "exposures"), "*.txt")
    return back.select(_folder(), "image_name", r(F.get("m", F.lit(0)), "m0"), r(F.get("m", F.lit(7)), "m7"), F.size("m").alias("n"))


@query(with_views("SELECT scene_id, (row_number() OVER (PARTITION BY scene_id ORDER BY image_id) - 1)::INT AS idx, 'train/' || image_id AS file_path, 0.7e0 AS angle, round(tx, 6) + 0.0 AS tx, 1e0 AS last FROM images", "images"))
def transform_files(spark, sf):
    zero, one = F.lit(0.0), F.lit(1.0)
    matrix = F.array(*[F.array(*[one if i == k else zero for k in range(3)], F.get("tvec", F.lit(i))) for i in range(3)], F.array(zero, zero, zero, one))
    frames = F.array_sort(F.collect_list(F.struct("image_id", F.concat(F.lit("train/"), F.col("image_id").cast("string")).alias("file_path"), matrix.alias("transform_matrix"))))
    rows = X.images(spark, sf).groupBy("scene_id").agg(F.to_json(F.struct(F.lit(0.7).alias("camera_angle_x"), frames.alias("frames"))).alias("value"))
    back = files.read_transforms_json(spark, text_files(rows, "transforms"), "*.txt")
    return back.select(_folder(), "idx", "file_path", r("camera_angle_x", "angle"), r(F.get("c2w", F.lit(3)), "tx"), r(F.get("c2w", F.lit(15)), "last"))


@query(with_views("SELECT scene_id, name FROM images WHERE image_id % 7 = 0", "images"))
def name_list_files(spark, sf):
    """Names between blank lines and spaces."""
    rows = X.images(spark, sf).filter("image_id % 7 = 0").select("scene_id", F.explode(F.array(F.concat(F.lit("  "), "name"), F.lit(" "))).alias("value"))
    return files.read_test_list(spark, text_files(rows, "lists"), "*.txt").select(_folder(), "name")


@query(with_views("SELECT image_id, 8 AS map_width, 8 AS map_height, round(floor(depth[1] * 60000) / 65536, 6) + 0.0 AS first, round(list_sum(list_transform(depth, lambda d: floor(d * 60000))) / 65536, 4) + 0.0 AS total FROM depth_maps", "depth_maps"))
def depth_map_files(spark, sf):
    """Sixteen-bit PNG files; all bytes of a file are one record."""
    root = shared_folder(spark, "depth-maps")

    @F.pandas_udf("binary")
    def png(depth: pd.Series) -> pd.Series:
        return pd.Series([files.encode_png(np.floor(np.reshape(d, (8, 8, 1)) * 60000).astype(np.uint16)) for d in depth])

    path = F.concat(F.lit(f"{root}/"), F.col("image_id").cast("string"), F.lit(".png"))
    placed(X.depth_maps(spark, sf).select(path.alias("path"), png("depth").alias("value")))
    back = files.read_inverse_depth(spark, root)
    total = F.aggregate("depth", F.lit(0.0), lambda a, x: a + x)
    return back.select(F.regexp_extract("path", r"/(\d+)\.png$", 1).cast("long").alias("image_id"), "map_width", "map_height", r(F.get("depth", F.lit(0)), "first"), r(total, "total", 4))


@query("SELECT label::BIGINT AS scene_id, vec_id, 8 AS height, 8 AS width, round(list_sum(list_transform(range(1, 65), lambda i: i * embedding[i]::DOUBLE)), 3) + 0.0 AS weighed FROM embeddings")
def dense_array_files(spark, sf):
    """Arrays of 8 x 8 values: sizes as text, then columns one after another."""
    root = shared_folder(spark, "dense")

    @F.pandas_udf("binary")
    def dense(values: pd.Series) -> pd.Series:
        return pd.Series([b"8&8&1&" + np.reshape(v, (8, 8)).astype("<f4").tobytes() for v in values])

    path = F.concat(F.lit(f"{root}/"), F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string"), F.lit(".bin"))
    placed(X.read(spark, sf, "embeddings").select(path.alias("path"), dense("embedding").alias("value")))
    back = files.read_dense_array(spark, root)
    weighed = F.aggregate(F.transform("values", lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    part = lambda k: F.regexp_extract("path", r"/(\d+)/(\d+)\.bin$", k).cast("long")
    return back.select(part(1).alias("scene_id"), part(2).alias("vec_id"), "height", "width", r(weighed, "weighed", 3))


_PLACED = "SELECT *, row_number() OVER (PARTITION BY scene_id, method ORDER BY name) - 1 AS idx, list_transform(render, lambda v: floor(least(greatest(v, 0), 1) * 255 + 0.5e0) / 255) AS pr, list_transform(gt, lambda v: floor(least(greatest(v, 0), 1) * 255 + 0.5e0) / 255) AS pg FROM pairs"
_SEEN_SCORES = "SELECT scene_id, method, idx, list_sum(list_transform(range(1, 65), lambda i: abs(pr[i] - pg[i]))) / 64 AS l1, list_sum(list_transform(range(1, 65), lambda i: (pr[i] - pg[i]) * (pr[i] - pg[i]))) / 64 AS e FROM placed"


@query(with_pairs("SELECT scene_id, method, round(avg(CASE WHEN e > 0 THEN -10 * log10(e) END), 4) + 0.0 AS psnr, round(avg(l1), 6) + 0.0 AS l1, count(*) AS n FROM seen_scores GROUP BY scene_id, method", placed=_PLACED, seen_scores=_SEEN_SCORES))
def scored_view_files(spark, sf):
    """Renders and ground truth as numbered PNG files, read back, paired by number, scored and reported as JSON."""
    root = shared_folder(spark, "views")
    idx = F.row_number().over(W.partitionBy("scene_id", "method").orderBy("name")) - 1
    written = sinks.write_views(pairs(spark, sf).withColumn("idx", idx), root, 1, 8, 8)
    # Names of the files stay in the tasks: they are as many as the views.
    written.write.format("noop").mode("overwrite").save()
    folders = X.tiles(spark, sf).select(F.explode(F.array(*[F.concat(F.lit(f"{root}/"), F.concat_ws("/", "scene_id", "method", F.lit(k))) for k in ("renders", "gt")])).alias("folder")).distinct()
    found = files.read_pixels_in(folders)
    part = lambda k: F.regexp_extract("path", r"/(\d+)/(\w+)/(renders|gt)/(\d+)\.png$", k)
    rows = found.select(part(1).cast("int").alias("scene_id"), part(2).alias("method"), part(3).alias("kind"), part(4).alias("name"), "rgb")
    side = lambda kind, name: rows.filter(F.col("kind") == kind).select("scene_id", "method", "name", F.col("rgb").alias(name))
    both = metrics.pair_views(side("renders", "render"), side("gt", "gt"))
    scores = both.select("scene_id", "method", metrics.l1(F.col("render"), F.col("gt")).alias("l1"), finite(metrics.psnr_image(F.col("render"), F.col("gt"))).alias("psnr"))
    report = sinks.results_json(metrics.scene_metrics(scores, ["l1", "psnr"]), {"PSNR": "psnr", "L1": "l1", "N": "n_views"})
    back = report.select("scene_id", F.explode(F.from_json("json", "map<string,struct<PSNR:double,L1:double,N:bigint>>")).alias("method", "v"))
    return back.select("scene_id", "method", r("v.PSNR", "psnr", 4), r("v.L1", "l1"), F.col("v.N").alias("n"))
