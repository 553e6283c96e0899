"""Depth alignment: sparse points seen in images against monocular inverse depth maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .views import small

LEAST_POINTS = 10
LEAST_RANGE = 1e-3


def matched_observations(observations: DataFrame, points: DataFrame) -> DataFrame:
    """Observations whose point id is between 0 and the scene's greatest."""
    top = points.groupBy("scene_id").agg(F.max("point3d_id").alias("_top"))
    return observations.join(small(top), "scene_id").filter((F.col("point3d_id") >= 0) & (F.col("point3d_id") <= F.col("_top"))).drop("_top")


def observed_points(matched: DataFrame, points: DataFrame) -> DataFrame:
    """Matched observations with their point; an id in range without a point stands at the origin."""
    place = points.select("scene_id", "point3d_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    return matched.join(place, ["scene_id", "point3d_id"], "left").fillna(0.0, ["px", "py", "pz"])


def dangling_track_entries(points: DataFrame, observations: DataFrame) -> DataFrame:
    """Entries of point tracks (image_id, point2d_idx) for which no observation names the point."""
    entries = points.select("scene_id", "point3d_id", F.explode("track").alias("t")).select("scene_id", "point3d_id", F.col("t.image_id").alias("image_id"), F.col("t.point2d_idx").alias("idx"))
    return entries.join(observations, ["scene_id", "image_id", "idx", "point3d_id"], "left_anti")


def with_inverse_depth(observed: DataFrame, poses: DataFrame) -> DataFrame:
    """``invdepth`` in the image's camera. ``poses``: scene_id, image_id, qvec, tvec, width, height; far fewer than observations."""
    rot = G.qvec_to_rotmat(F.col("qvec"))
    seen = observed.join(poses, ["scene_id", "image_id"])
    return seen.withColumn("invdepth", G.inverse_depth(rot, F.col("tvec"), F.col("px"), F.col("py"), F.col("pz"))).drop("qvec", "tvec")


def in_frame(x: Column, y: Column, width: Column, height: Column, s: Column, invdepth: Column) -> Column:
    """Inside the depth map, whose scale is ``s`` times the image's on both axes, and before the camera."""
    return (x * s >= 0) & (y * s >= 0) & (x * s < width * s) & (y * s < height * s) & (invdepth > 0)


def bilinear(grid: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values between the cells of a grid, whose border goes on outside."""
    h, w = grid.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    i, j = np.floor(y).astype(int), np.floor(x).astype(int)
    i2, j2 = np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1)
    fy, fx = y - i, x - j
    return grid[i, j] * (1 - fx) * (1 - fy) + grid[i, j2] * fx * (1 - fy) + grid[i2, j] * (1 - fx) * fy + grid[i2, j2] * fx * fy


_SAMPLED = "scene_id int, image_id long, invdepth double, mono double, valid boolean"


def sample_depth(seen: DataFrame, maps: DataFrame) -> DataFrame:
    """Each observation with the map's value at its place; images without a map give none.

    Observations and maps meet by image: a task holds one map and the
    features of one image, both bounded.
    """

    def sample(obs: pd.DataFrame, grid: pd.DataFrame) -> pd.DataFrame:
        if not len(grid) or not len(obs):
            return pd.DataFrame({"scene_id": [], "image_id": [], "invdepth": [], "mono": [], "valid": []}).astype({"scene_id": "int32", "image_id": "int64", "valid": bool})
        m = grid.iloc[0]
        values = np.asarray(m["depth"], float).reshape(int(m["map_height"]), int(m["map_width"]))
        s = m["map_height"] / obs["height"].to_numpy()
        x, y = obs["x"].to_numpy() * s, obs["y"].to_numpy() * s
        inv = obs["invdepth"].to_numpy(float)
        valid = (x >= 0) & (y >= 0) & (x < obs["width"].to_numpy() * s) & (y < obs["height"].to_numpy() * s) & (inv > 0)
        return pd.DataFrame({"scene_id": obs["scene_id"], "image_id": obs["image_id"], "invdepth": inv, "mono": bilinear(values, x, y), "valid": valid})

    rows = seen.select("scene_id", "image_id", "x", "y", "width", "height", "invdepth")
    return rows.groupBy("scene_id", "image_id").cogroup(maps.groupBy("scene_id", "image_id")).applyInPandas(sample, _SAMPLED)


def middle(value: Column, accuracy: int | None) -> Column:
    """The median; with ``accuracy`` one of the values whose rank is off the middle by at most a share of 1 / accuracy, from sketches that merge before the shuffle."""
    return F.median(value) if accuracy is None else F.percentile_approx(value, 0.5, accuracy)


def medians(sampled: DataFrame, accuracy: int | None = None) -> DataFrame:
    """(scene_id, image_id, t_c, t_m, span, n): medians of both inverse depths of the valid observations, their number, and the span of all."""
    ok = lambda c: F.when(F.col("valid"), F.col(c))
    return sampled.groupBy("scene_id", "image_id").agg(
        middle(ok("invdepth"), accuracy).alias("t_c"),
        middle(ok("mono"), accuracy).alias("t_m"),
        (F.max("invdepth") - F.min("invdepth")).alias("span"),
        F.count(ok("invdepth")).alias("n"),
    )


def fit_depth_scale(sampled: DataFrame, accuracy: int | None = None) -> DataFrame:
    """(scene_id, image_id, scale, offset) from medians and mean absolute deviations of both inverse depths.

    (0, 0) unless more than ten observations are valid, all matched ones
    span more than 1e-3, and the map's values deviate at all. Medians are exact, as an
    image's features are bounded; groups that aren't take ``accuracy``
    (``middle``), and nothing is gathered.
    """
    key = ["scene_id", "image_id"]
    ok = lambda c: F.when(F.col("valid"), F.col(c))
    mid = medians(sampled, accuracy)
    spread = sampled.join(mid, key).groupBy(*key).agg(
        F.avg(F.abs(ok("invdepth") - F.col("t_c"))).alias("s_c"),
        F.avg(F.abs(ok("mono") - F.col("t_m"))).alias("s_m"),
    )
    scale = F.try_divide("s_c", "s_m")
    good = (F.col("n") > LEAST_POINTS) & (F.col("span") > LEAST_RANGE) & scale.isNotNull()
    fitted = mid.join(spread, key)
    return fitted.select(*key, F.when(good, scale).otherwise(0.0).alias("scale"), F.when(good, F.col("t_c") - F.col("t_m") * scale).otherwise(0.0).alias("offset"))


def sampled_depth(images: DataFrame, cameras: DataFrame, points: DataFrame, observations: DataFrame, maps: DataFrame) -> DataFrame:
    """Each matched observation of an image with a depth map: both inverse depths, and whether it is valid."""
    poses = images.join(cameras.select("camera_id", "width", "height"), "camera_id").select("scene_id", "image_id", "qvec", "tvec", "width", "height")
    slim = observations.select("scene_id", "image_id", "x", "y", "point3d_id")
    seen = with_inverse_depth(observed_points(matched_observations(slim, points), points), poses)
    return sample_depth(seen, maps)


def align(images: DataFrame, cameras: DataFrame, points: DataFrame, observations: DataFrame, maps: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Scale and offset of each image that has a depth map and a matched observation, or (0, 0)."""
    fitted = fit_depth_scale(sampled_depth(images, cameras, points, observations, maps), accuracy)
    return maps.select("scene_id", "image_id").join(fitted, ["scene_id", "image_id"], "left").fillna(0.0, ["scale", "offset"])


def reliable_depth(scale: Column, med_scale: Column) -> Column:
    """Within a fifth and five times the median; a view without parameters counts as reliable."""
    return F.when(scale.isNull(), True).otherwise((scale >= 0.2 * med_scale) & (scale <= 5 * med_scale))
