"""Views: images with their cameras, hold-outs, scene extents, and numberings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.appearance import IDENTITY_EXPOSURE
from ..functions.scalars import image_stem

#: Rows of a narrow table (cameras, a row for each scene) that may be broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


#: Bytes of such a table, by the length of their rows as JSON.
BROADCAST_BYTES = 256 << 20


def small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows and these at most ``most_bytes``, which one job over their lengths finds out."""
    lengths = df.select(F.length(F.to_json(F.struct("*"))).alias("n")).limit(most + 1)
    rows, size = lengths.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return F.broadcast(df) if rows <= most and size <= most_bytes else df


def supported_cameras(cameras: DataFrame) -> DataFrame:
    return cameras.filter(F.col("model").isin(*G.FOCALS))


def rejected_cameras(cameras: DataFrame) -> DataFrame:
    return cameras.filter(~F.col("model").isin(*G.FOCALS) | F.col("model").isNull())


def join_cameras(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """Each image with the intrinsics of its camera."""
    keys = ["scene_id", "camera_id"] if "scene_id" in cameras.columns and "scene_id" in images.columns else ["camera_id"]
    return images.join(small(cameras), keys)


def derive(views: DataFrame) -> DataFrame:
    """``views`` with rotation, field of view and camera centre."""
    fovx, fovy = G.camera_fov(F.col("model"), F.col("params"), F.col("width"), F.col("height"))
    rot = G.qvec_to_rotmat(F.col("qvec"))
    return views.withColumns({"rot": rot, "fovx": fovx, "fovy": fovy}).withColumn("centre", G.camera_center(F.col("rot"), F.col("tvec")))


def positive_scale(scale: Column) -> Column:
    return F.when(scale > 0, scale)


def median_positive_scale(params: DataFrame, accuracy: int | None = None) -> DataFrame:
    """(scene_id, med_scale): the median of the positive scales, 0 without any; with ``accuracy`` from sketches (``depth.middle``)."""
    scale = positive_scale(F.col("scale"))
    middle = F.median(scale) if accuracy is None else F.percentile_approx(scale, 0.5, accuracy)
    return params.groupBy("scene_id").agg(F.coalesce(middle, F.lit(0.0)).alias("med_scale"))


def join_depth_params(views: DataFrame, params: DataFrame) -> DataFrame:
    """Depth scale and offset by the image's stem, with the scene's median scale; null where there is no row."""
    params = params.join(small(median_positive_scale(params)), "scene_id")
    return views.withColumn("image_stem", image_stem(F.col("name"))).join(params, ["scene_id", "image_stem"], "left")


def join_exposures(views: DataFrame, exposures: DataFrame) -> DataFrame:
    """The exposure of each view by its name; the identity where there is none."""
    joined = views.join(exposures.select("scene_id", F.col("image_name").alias("name"), "m"), ["scene_id", "name"], "left")
    return joined.withColumn("m", F.coalesce("m", F.array(*[F.lit(v) for v in IDENTITY_EXPOSURE])))


def enumerate_views(views: DataFrame, order: str | list[str] = "name", index: str = "uid") -> DataFrame:
    """Place of each view in its scene, from 0, by code point order of ``order``."""
    return views.withColumn(index, F.row_number().over(W.partitionBy("scene_id").orderBy(order)) - 1)


def holdout_split(views: DataFrame, hold: int | None = 8, train_test_exp: bool = False, order: str | list[str] = "name") -> DataFrame:
    """``is_test`` and ``is_train``: every ``hold``-th view by ``order`` is test (none if falsy); with ``train_test_exp`` test views train too."""
    test = enumerate_views(views, order, "_place").withColumn("is_test", F.col("_place") % hold == 0 if hold else F.lit(False)).drop("_place")
    return test.withColumn("is_train", F.lit(True) if train_test_exp else ~F.col("is_test"))


def split_by_list(views: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test): test are the views whose name is listed."""
    listed = names.select("name").distinct()
    return views.join(listed, "name", "left_anti"), views.join(listed, "name", "left_semi")


def merge_train_test(train: DataFrame, test: DataFrame, evaluate: bool) -> DataFrame:
    """The views to train on: test views too unless they are kept for evaluation."""
    return train if evaluate else train.unionByName(test)


def train_test_overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.select("scene_id", "name").intersect(test.select("scene_id", "name"))


def scene_normalization(views: DataFrame) -> DataFrame:
    """(scene_id, tx, ty, tz, radius): minus the mean camera centre, and 1.1 times the largest distance from it."""
    axes = ("cx", "cy", "cz")
    centres = views.select("scene_id", *[F.get("centre", F.lit(k)).alias(a) for k, a in enumerate(axes)])
    means = centres.groupBy("scene_id").agg(*[F.avg(a).alias(f"m{a}") for a in axes])
    # One row for each scene.
    apart = sum(((F.col(a) - F.col(f"m{a}")) * (F.col(a) - F.col(f"m{a}")) for a in axes[1:]), (F.col("cx") - F.col("mcx")) * (F.col("cx") - F.col("mcx")))
    radius = centres.join(means, "scene_id").groupBy("scene_id").agg(F.max(F.sqrt(apart)).alias("far"))
    return means.join(radius, "scene_id").select("scene_id", *[(-F.col(f"m{a}")).alias(f"t{a[1]}") for a in axes], (F.col("far") * 1.1).alias("radius"))


def first_n_per_group(views: DataFrame, group: list[str], n: int = 5, order: str = "name") -> DataFrame:
    return views.withColumn("_k", F.row_number().over(W.partitionBy(*group).orderBy(order))).filter(F.col("_k") <= n).drop("_k")


def validation_sample(views: DataFrame, places: tuple[int, ...] = (5, 10, 15, 20, 25), order: str | list[str] = "name") -> DataFrame:
    """The views at ``places`` modulo the scene's number of views; a view comes again if two places fall on it."""
    numbered = enumerate_views(views, order, "pos").withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("scene_id")))
    asked = F.explode(F.array(*[F.lit(p) for p in places])).alias("place")
    wanted = numbered.groupBy("scene_id").agg(F.max("_n").alias("_n")).select("scene_id", "_n", asked)
    return wanted.select("scene_id", "place", F.pmod("place", "_n").alias("pos")).join(numbered.drop("_n"), ["scene_id", "pos"])


def closest_view(views: DataFrame, users: DataFrame) -> DataFrame:
    """For each user camera (user_id, scene_id, ux, uy, uz) the view of its scene whose centre is nearest; of equals the least id."""
    c = [F.get("centre", F.lit(k)) for k in range(3)]
    apart = sum(((a - F.col(u)) * (a - F.col(u)) for a, u in zip(c[1:], ("uy", "uz"), strict=True)), (c[0] - F.col("ux")) * (c[0] - F.col("ux")))
    near = views.join(small(users), "scene_id").withColumn("dist2", apart)
    return near.groupBy("user_id").agg(F.min(F.struct("dist2", "image_id")).alias("m")).select("user_id", F.col("m.image_id").alias("image_id"), F.sqrt("m.dist2").alias("distance"))


def order_for_cameras_json(views: DataFrame) -> DataFrame:
    """``id``: test views first, then the others, each by name."""
    by = W.partitionBy("scene_id").orderBy(F.desc("is_test"), "name")
    return views.withColumn("id", F.row_number().over(by) - 1)


def shuffle_views(views: DataFrame, seed: int = 0) -> DataFrame:
    """A seeded order of each scene's views that doesn't depend on partitions."""
    by = W.partitionBy("scene_id").orderBy(F.xxhash64(F.lit(seed), "name"), "name")
    return views.withColumn("shuffled", F.row_number().over(by) - 1)


def epoch_sampler(views: DataFrame, epochs: int, seed: int = 0) -> DataFrame:
    """Each view once in each epoch, in an order of the epoch's own."""
    each = views.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    by = W.partitionBy("scene_id", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "name"), "name")
    return each.withColumn("step", F.row_number().over(by) - 1)


def latest_iteration(paths: DataFrame) -> DataFrame:
    """(scene_id, iteration): the greatest number of the ``iteration_N`` folders, as a number."""
    number = F.regexp_extract("path", r"iteration_(\d+)(?:/|$)", 1)
    return paths.filter(number != "").groupBy("scene_id").agg(F.max(number.cast("int")).alias("iteration"))
