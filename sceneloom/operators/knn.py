"""Exact nearest neighbours of scene points in adaptive regions.

Points of equal place are one, with a count. A point looks into its own region
first; the k-th distance found there bounds the ball that can hold anything
nearer, and only other regions that this ball touches are asked as well.
Regions are as small as points are dense (``regions``), so that a far point or
a tight cluster costs what evenly spread points cost.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import regions

#: Points of a region, and points that ask one region in one task.
LEAF, BLOCK = 512, 1024
LEAST = 1e-7
AXES = ["x", "y", "z"]


def _nearest(at: np.ndarray, place: np.ndarray, there: np.ndarray, its: np.ndarray, n: np.ndarray, k: int) -> list[np.ndarray]:
    """Up to ``k`` least squared distances to other places, each as often as it has points."""
    times = np.minimum(n, k)
    d = np.zeros((len(at), int(times.sum())))
    for a in range(at.shape[1]):
        d += (at[:, a, None] - np.repeat(there[:, a], times)[None]) ** 2
    d[place[:, None] == np.repeat(its, times)[None]] = np.inf
    near = np.sort(np.partition(d, k - 1)[:, :k] if d.shape[1] > k else d)
    return [row[row < np.inf] for row in near]


def _own(k: int):
    """Squared distances within a region; the point's own place holds n - 1 others at distance 0."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at, place, n, out = rows[AXES].to_numpy(), rows["place"].to_numpy(), rows["n"].to_numpy(), []
        asking = np.flatnonzero(n <= k)
        for s in range(0, len(asking), BLOCK):
            part = asking[s : s + BLOCK]
            out += _nearest(at[part], place[part], at, place, n, k)
        d2 = [np.concatenate([np.zeros(m - 1), d])[:k] for m, d in zip(n[asking], out, strict=True)]
        found = rows.iloc[asking][["scene_id", "place", *AXES]]
        return found.assign(home=rows["region"].iloc[0], d2=pd.Series(d2, found.index, dtype=object), reach=[np.sqrt(d[-1]) * (1 + 1e-9) if len(d) == k else np.inf for d in d2])

    return run


def _other(k: int):
    def run(asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(there):
            return pd.DataFrame({"scene_id": [], "place": [], "d2": []}).astype({"scene_id": "int32", "place": "int64", "d2": object})
        near = _nearest(asking[AXES].to_numpy(), asking["place"].to_numpy(), there[[f"p_{a}" for a in AXES]].to_numpy(), there["p_place"].to_numpy(), there["p_n"].to_numpy(), k)
        return pd.DataFrame({"scene_id": asking["scene_id"].to_numpy(), "place": asking["place"].to_numpy(), "d2": pd.Series(near, dtype=object)})

    return run


def nearest_sq_dist(points: DataFrame, keep: Callable[[DataFrame, str], DataFrame], k: int = 3, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(scene_id, point3d_id, mean_sq_dist): mean squared distance to the ``k`` nearest other points, at least 1e-7.

    ``keep`` writes a table and gives it back, to cut lineage. Points of
    equal place are at distance 0. With ``k`` or fewer points in a scene the
    mean is over those there are; a single point gets 1e-7. A point with a
    coordinate that is null, infinite or not a number is no one's neighbour,
    and its mean is null.
    """
    numbered = keep(points.select(F.col("scene_id").cast("int").alias("scene_id"), "point3d_id", *[F.col(a).cast("double").alias(a) for a in AXES]), "points")
    finite = reduce(lambda a, b: a & b, [F.coalesce(F.abs(a) < float("inf"), F.lit(False)) for a in AXES])
    odd = numbered.filter(~finite).select("scene_id", "point3d_id", F.lit(None).cast("double").alias("mean_sq_dist"))
    numbered = numbered.filter(finite)
    places = numbered.groupBy("scene_id", *AXES).agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.xxhash64(*AXES))
    found = regions.split(places, keep, ["scene_id"], AXES, ["place"], leaf)
    own = keep(found.rows.groupBy("scene_id", "region").applyInPandas(_own(k), "scene_id int, place long, x double, y double, z double, home long, d2 array<double>, reach double"), "own")
    # With all neighbours at distance 0 nothing is nearer.
    asking = regions.reached(found, own.filter("reach > 0").drop("d2"), AXES, "reach").filter("region <> home")
    asking = keep(asking.select("scene_id", "region", "place", *AXES), "asking")
    parts = asking.groupBy("scene_id", "region").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    asking = asking.join(parts, ["scene_id", "region"]).withColumn("part", F.pmod("place", F.col("parts")).cast("int"))
    there = found.rows.join(parts, ["scene_id", "region"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = ["scene_id", "region", "part"]
    # Both sides come from the same points: names of its own keep them apart.
    there = there.select(*[F.col(c).alias(f"p_{c}") for c in (*key, "place", "n", *AXES)])
    near = asking.groupBy(*key).cogroup(there.groupBy(*[f"p_{c}" for c in key])).applyInPandas(_other(k), "scene_id int, place long, d2 array<double>")
    both = own.select("scene_id", "place", "d2").unionByName(near).groupBy("scene_id", "place").agg(F.slice(F.sort_array(F.flatten(F.collect_list("d2"))), 1, k).alias("d2"))
    mean = F.greatest(F.coalesce(F.try_divide(F.aggregate("d2", F.lit(0.0), lambda a, x: a + x), F.size("d2").cast("double")), F.lit(0.0)), F.lit(LEAST))
    crowded = found.rows.filter(F.col("n") > k).select("scene_id", "place", F.lit(LEAST).alias("mean_sq_dist"))
    told = both.select("scene_id", "place", mean.alias("mean_sq_dist")).unionByName(crowded)
    return numbered.withColumn("place", F.xxhash64(*AXES)).join(told, ["scene_id", "place"]).select("scene_id", "point3d_id", "mean_sq_dist").unionByName(odd)
