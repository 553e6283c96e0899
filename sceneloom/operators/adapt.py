"""Growing and pruning primitive tables from accumulated statistics.

Nothing here shuffles but the aggregation of view statistics and its one
join with the primitives: rows are flagged once, then cloned, split and
pruned where they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.appearance import IDENTITY_EXPOSURE, logit, rgb_to_sh, sh_to_rgb, sigmoid
from ..functions.geometry import _dot, items, normalized, qvec_to_rotmat

PERCENT_DENSE = 0.01
MIN_OPACITY = 0.005
GRAD_THRESHOLD = 0.0002
STATS = ("grad_sum", "denom", "max_radius")


def visible(stats: DataFrame) -> DataFrame:
    return stats.filter(F.col("radius") > 0)


def accumulate_prim_stats(stats: DataFrame) -> DataFrame:
    """Sum of gradient lengths, number of views and largest radius of each primitive, over the views that see it."""
    length = F.sqrt(F.col("grad_x") * F.col("grad_x") + F.col("grad_y") * F.col("grad_y"))
    return visible(stats).groupBy("scene_id", "prim_id").agg(F.sum(length).alias("grad_sum"), F.count(F.lit(1)).alias("denom"), F.max("radius").alias("max_radius"))


def visibility_count(stats: DataFrame, rsd: float | None = None) -> DataFrame:
    """Views that see each primitive: exact, or within ``rsd`` by a sketch."""
    views = F.approx_count_distinct("view_id", rsd) if rsd else F.count_distinct("view_id")
    return visible(stats).groupBy("scene_id", "prim_id").agg(views.alias("n_views"))


def mean_gradient(grad_sum: Column, denom: Column) -> Column:
    """0 for what was never seen."""
    return F.coalesce(F.try_divide(grad_sum, denom), F.lit(0.0))


def with_stats(primitives: DataFrame, stats: DataFrame) -> DataFrame:
    return primitives.join(stats, ["scene_id", "prim_id"], "left").withColumn("grad", mean_gradient(F.col("grad_sum"), F.col("denom")))


def max_scale(scale: Column) -> Column:
    return F.exp(F.array_max(scale))


def clone_candidates(grad: Column, scale: Column, extent: Column | float, threshold: float, dense: float = PERCENT_DENSE) -> Column:
    return (grad >= threshold) & (max_scale(scale) <= dense * extent)


def split_candidates(grad: Column, scale: Column, extent: Column | float, threshold: float, dense: float = PERCENT_DENSE) -> Column:
    return (grad >= threshold) & (max_scale(scale) > dense * extent)


def prune_predicate(opacity: Column, scale: Column, extent: Column | float, size_rule: Column | bool, min_opacity: float = MIN_OPACITY) -> Column:
    """Nearly transparent, or, with the size rule, larger than a tenth of the scene."""
    return (sigmoid(opacity) < min_opacity) | (F.lit(size_rule) if isinstance(size_rule, bool) else size_rule) & (max_scale(scale) > 0.1 * extent)


def hashed_normal(seed: int, *key: Column) -> Column:
    """A standard normal draw that depends on the seed and key alone (Box-Muller of two hashed uniforms)."""
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *key), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return F.sqrt(-2 * F.ln(unit(1))) * F.cos(2 * math.pi * unit(2))


def clones(flagged: DataFrame) -> DataFrame:
    return flagged.filter("clone").withColumns({"kind": F.lit("clone"), "child": F.lit(0)})


def children(flagged: DataFrame, n: int = 2, jitter: float = 1.0, seed: int = 0) -> DataFrame:
    """``n`` smaller primitives around each one that is split, drawn from its own shape; ``jitter`` 0 keeps them at its centre."""
    rows = flagged.filter("split").withColumns({"kind": F.lit("split"), "child": F.explode(F.sequence(F.lit(1), F.lit(n)))})
    rows = rows.withColumn("scale", F.transform("scale", lambda s: F.ln(F.exp(s) / (0.8 * n))))
    if not jitter:
        return rows
    parent = [F.exp(s) * (0.8 * n) for s in items(F.col("scale"), 3)]
    draw = [jitter * s * hashed_normal(seed, F.col("scene_id"), F.col("prim_id"), F.col("child"), F.lit(axis)) for axis, s in enumerate(parent)]
    r = items(qvec_to_rotmat(normalized(F.col("rot"), 4)), 9)
    return rows.withColumns({a: F.col(a) + _dot(r[3 * k : 3 * k + 3], draw) for k, a in enumerate("xyz")})


def densify_and_prune(
    primitives: DataFrame, stats: DataFrame, extent: float, threshold: float = GRAD_THRESHOLD, size_rule: bool = True, jitter: float = 1.0, seed: int = 0, max_screen_size: int | None = None
) -> DataFrame:
    """The next primitive table: survivors, clones and children, less what is pruned.

    ``parent``, ``kind`` and ``child`` name each row; new rows have no
    statistics yet. Statistics on screen sizes are zeroed before they could
    prune anything; give ``max_screen_size`` to prune by those from before.
    """
    flagged = with_stats(primitives, stats).withColumns(
        {
            "clone": clone_candidates(F.col("grad"), F.col("scale"), extent, threshold),
            "split": split_candidates(F.col("grad"), F.col("scale"), extent, threshold),
            "parent": F.col("prim_id"),
        }
    )
    kept = flagged.filter("not split").withColumns({"kind": F.lit("own"), "child": F.lit(0)})
    rows = kept.unionByName(clones(flagged)).unionByName(children(flagged, jitter=jitter, seed=seed))
    gone = prune_predicate(F.col("opacity"), F.col("scale"), extent, size_rule)
    if max_screen_size is not None:
        gone = gone | (F.col("kind") == "own") & (F.coalesce("max_radius", F.lit(0)) > max_screen_size)
    own = F.when(F.col("kind") == "own", F.col("parent")).otherwise(F.xxhash64("parent", "kind", "child"))
    return rows.filter(~gone).withColumn("prim_id", own).drop("clone", "split", "grad", *STATS)


def reset_opacity(opacity: Column, most: float = 0.01) -> Column:
    return logit(F.least(sigmoid(opacity), F.lit(most)))


def init_primitives(points: DataFrame, neighbours: DataFrame, degree: int = 3) -> DataFrame:
    """One primitive for each point: its colour, a size from its nearest neighbours (``mean_sq_dist``), a tenth of opacity."""
    size = F.ln(F.sqrt(F.greatest(F.col("mean_sq_dist"), F.lit(1e-7))))
    return points.join(neighbours, ["scene_id", "point3d_id"]).select(
        "scene_id",
        F.col("point3d_id").alias("prim_id"),
        "x",
        "y",
        "z",
        F.array(*[rgb_to_sh(F.col(c) / 255.0) for c in ("r", "g", "b")]).alias("f_dc"),
        F.array_repeat(F.lit(0.0), 3 * ((degree + 1) ** 2 - 1)).alias("f_rest"),
        logit(F.lit(0.1)).alias("opacity"),
        F.array(size, size, size).alias("scale"),
        F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0)]).alias("rot"),
    )


def init_exposures(views: DataFrame) -> DataFrame:
    return views.select("scene_id", F.col("name").alias("image_name"), F.array(*[F.lit(v) for v in IDENTITY_EXPOSURE]).alias("m"))


def random_point_cloud(spark, n: int = 100_000, half: float = 1.3, seed: int = 0, scene_id: int = 0) -> DataFrame:
    """Points spread evenly over a cube, with dim random colours; the same ones however they are partitioned."""
    unit = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), F.lit(1 << 53)) / float(1 << 53)
    place = [(unit(k) * 2 * half - half).alias(a) for k, a in enumerate("xyz")]
    colour = [sh_to_rgb(unit(3 + k) / 255).alias(c) for k, c in enumerate("rgb")]
    return spark.range(n).select(F.lit(scene_id).alias("scene_id"), F.col("id").alias("point3d_id"), *place, *colour)
