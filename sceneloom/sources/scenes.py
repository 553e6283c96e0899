"""Scene loaders by kind, with one schema of views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import views
from . import calibration, files

VIEW = ("scene_id", "name", "rot", "tvec", "centre", "fovx", "fovy", "width", "height", "depth_scale", "depth_offset", "med_scale", "exposure")


def with_optional_parts(rows: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    """Depth parameters (``sparse/0/depth_params.json``) and exposures (``exposure.json``) of the scenes that have them.

    Views without depth parameters have nulls, those without an exposure the identity. A scene without
    the files is no error.
    """
    scene = lambda pattern: F.regexp_extract("path", pattern, 1).alias("scene_id")
    params = files.read_depth_params(spark, root).select(scene(r"([^/]+)/sparse/"), "image_stem", F.col("scale").alias("scale"), "offset")
    exposures = files.read_exposures(spark, root).select(scene(r"([^/]+)/exposure\.json$"), "image_name", "m")
    joined = views.join_exposures(views.join_depth_params(rows, params), exposures)
    return joined.withColumnsRenamed({"scale": "depth_scale", "offset": "depth_offset", "m": "exposure"})


def load_calibrated(spark: SparkSession, root: str, ext: str = "bin") -> DataFrame:
    """Views of all calibrated scenes under ``root`` whose cameras have no distortion, with what optional parts there are."""
    cameras = views.supported_cameras(calibration.read_cameras(spark, root, ext))
    images = calibration.read_images(spark, root, ext).drop("points2d")
    return with_optional_parts(views.derive(views.join_cameras(images, cameras)), spark, root).select(*VIEW)


def load_synthetic(spark: SparkSession, root: str, width: int = 800, height: int = 800, extension: str = ".png") -> DataFrame:
    """Views of all scenes with transform files; the frames' sizes are not in these files."""
    frames = files.read_transforms_json(spark, root)
    rot, t = G.c2w_opengl_to_w2c(F.col("c2w"))
    size = {"width": F.lit(width).cast("long"), "height": F.lit(height).cast("long")}
    name = F.concat(F.substring_index("file_path", "/", -1), F.lit(extension))
    rows = frames.withColumns({"scene_id": F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), "name": name, "rot": rot, "tvec": t, **size, "fovx": F.col("camera_angle_x")})
    rows = rows.withColumns({"fovy": G.fovy_from_fovx(F.col("fovx"), F.col("width"), F.col("height")), "centre": G.camera_center(F.col("rot"), F.col("tvec"))})
    return with_optional_parts(rows, spark, root).select(*VIEW)


#: Add a kind of scene by adding its loader.
LOADERS: dict[str, Callable[..., DataFrame]] = {"calibrated": load_calibrated, "synthetic": load_synthetic}


def load_scene(spark: SparkSession, root: str, kind: str, **options) -> DataFrame:
    if kind not in LOADERS:
        raise ValueError(f"no loader for scenes of kind {kind!r}")
    return LOADERS[kind](spark, root, **options)
