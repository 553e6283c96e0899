"""Scores of rendered views against ground truth. Images are arrays of doubles, channel after channel, row-major."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..jobs.scratch import keeper

SSIM_TAPS, SSIM_SIGMA = 11, 1.5
SSIM_C1, SSIM_C2 = 0.01**2, 0.03**2


#: What tells views apart where file names do.
VIEW = ("scene_id", "method", "name")


def pair_views(renders: DataFrame, truth: DataFrame, key: tuple[str, ...] = VIEW) -> DataFrame:
    """Renders with the ground truth of the same scene, method and file name; of the same ``key`` where names come again within a scene."""
    return renders.join(truth, list(key))


def missing_truth(renders: DataFrame, truth: DataFrame, key: tuple[str, ...] = VIEW) -> DataFrame:
    return renders.join(truth, list(key), "left_anti")


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def l1(a: Column, b: Column) -> Column:
    return _mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def mse(a: Column, b: Column) -> Column:
    return _mean(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def psnr_of(error: Column) -> Column:
    """Infinite without error."""
    return F.when(error == 0, F.lit(float("inf"))).otherwise(-10 * F.log10(F.when(error > 0, error)))


def psnr_image(a: Column, b: Column) -> Column:
    """Over all channels at once."""
    return psnr_of(mse(a, b))


def psnr_channel_mean(a: Column, b: Column, channels: int, pixels: int) -> Column:
    """Mean of each channel's own."""
    each = [psnr_of(mse(F.slice(a, k * pixels + 1, pixels), F.slice(b, k * pixels + 1, pixels))) for k in range(channels)]
    return sum(each[1:], each[0]) / channels


def masked_l1(a: Column, b: Column, mask: Column) -> Column:
    """Over all pixels; masked ones count as 0."""
    return _mean(F.zip_with(F.zip_with(a, b, lambda x, y: F.abs(x - y)), mask, lambda d, m: d * m))


def _blur(stack: np.ndarray) -> np.ndarray:
    """Gaussian window over the last two axes, zeros outside: one pass for each axis."""
    at = np.arange(SSIM_TAPS) - SSIM_TAPS // 2
    taps = np.exp(-(at**2) / (2 * SSIM_SIGMA**2))
    taps /= taps.sum()
    for axis in (-1, -2):
        pad = [(0, 0)] * stack.ndim
        pad[axis] = (SSIM_TAPS // 2,) * 2
        padded, n = np.pad(stack, pad), stack.shape[axis]
        stack = sum(t * (padded[..., k : k + n] if axis == -1 else padded[..., k : k + n, :]) for k, t in enumerate(taps))
    return stack


def ssim_map(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Structural similarity at each pixel, by windows over the last two axes."""
    ma, mb = _blur(a), _blur(b)
    va, vb, cov = _blur(a * a) - ma * ma, _blur(b * b) - mb * mb, _blur(a * b) - ma * mb
    return (2 * ma * mb + SSIM_C1) * (2 * cov + SSIM_C2) / ((ma * ma + mb * mb + SSIM_C1) * (va + vb + SSIM_C2))


def ssim_images(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean structural similarity of images (n, channels, height, width)."""
    return ssim_map(a, b).mean((1, 2, 3))


def ssim(a: Column, b: Column, channels: int, height: int, width: int) -> Column:
    """Spark has no convolution: batches of images of one size go to NumPy."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        shape = (-1, channels, height, width)
        ok = x.notna() & y.notna()
        out = pd.Series(np.nan, x.index)
        if ok.any():
            out[ok] = ssim_images(np.stack(x[ok].to_list()).reshape(shape), np.stack(y[ok].to_list()).reshape(shape))
        return out.astype(object).where(ok, None)

    return run(a, b)


def _lists(values: np.ndarray) -> pa.Array:
    """Each row of ``values`` as a list."""
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(values.ravel()))


def _stacked(lists: pa.ListArray, at: np.ndarray) -> np.ndarray:
    """The lists at ``at``, of one length, as rows."""
    return lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)


def _alike(*columns: np.ndarray) -> list[np.ndarray]:
    """Places of the rows that agree in all columns."""
    if not len(columns[0]):
        return []
    _, which = np.unique(np.stack(columns, 1), axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    return np.split(order, np.flatnonzero(np.diff(which.ravel()[order])) + 1)


#: What a strip says of itself, and what comes with it.
_STRIP = ("top", "left", "high", "wide")
_PLACE = ("height", "width", "tile_y", "tile_x")
#: Values of halos that are scored at a time.
_BLOCK = 1 << 20


def _tiles_and_strips(tile: int, halo: int):
    """Each tile to itself, and the strips of it that lie in the halo of another to that. Tiles of one place in frames of one size go together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            place = [rows.column(c).to_numpy(zero_copy_only=False) for c in _PLACE]
            lengths = pc.list_value_length(rows.column("a")).to_numpy(zero_copy_only=False)
            for at in _alike(*place, lengths):
                height, width, tile_y, tile_x = (int(v[at[0]]) for v in place)
                y0, x0 = tile_y * tile, tile_x * tile
                high, wide = min(tile, height - y0), min(tile, width - x0)
                a, b = (_stacked(rows.column(c), at).reshape(len(at), -1, high, wide) for c in "ab")
                image = rows.column("image").take(pa.array(at))
                for ty in range(max(0, (y0 - halo) // tile), min(-(-height // tile) - 1, (y0 + high - 1 + halo) // tile) + 1):
                    for tx in range(max(0, (x0 - halo) // tile), min(-(-width // tile) - 1, (x0 + wide - 1 + halo) // tile) + 1):
                        top, left = max(y0, ty * tile - halo), max(x0, tx * tile - halo)
                        end, right = min(y0 + high, (ty + 1) * tile + halo), min(x0 + wide, (tx + 1) * tile + halo)
                        cut = (slice(None), slice(None), slice(top - y0, end - y0), slice(left - x0, right - x0))
                        ints = [pa.array(np.full(len(at), v, np.int32)) for v in (height, width, ty, tx, top, left, end - top, right - left)]
                        yield pa.RecordBatch.from_arrays([image, *ints, *(_lists(v[cut].reshape(len(at), -1)) for v in (a, b))], names=["image", *_PLACE, *_STRIP, "a", "b"])

    return run


def _ssim_of_tiles(tile: int, halo: int):
    """Sums of the structural similarity over tiles' own pixels, from their strips; outside of the image all is 0. Tiles of one place and the same strips go together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            place = [rows.column(c).to_numpy(zero_copy_only=False) for c in _PLACE]
            lists = rows.column("strips")
            count = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            first = np.cumsum(count) - count
            strips = lists.flatten()
            parts = {c: strips.field(c) for c in (*_STRIP, "a", "b")}
            ints = {c: parts[c].to_numpy(zero_copy_only=False) for c in _STRIP}
            lengths = pc.list_value_length(parts["a"]).to_numpy(zero_copy_only=False)
            total, n = np.zeros(rows.num_rows), np.zeros(rows.num_rows, np.int64)
            for same in _alike(*place, count):
                # Strips come sorted by place: the k-th ones of tiles alike are alike but where one has been given strips of its own.
                at = first[same][:, None] + np.arange(count[same[0]])
                for some in _alike(*(v[at].T[k] for v in (*ints.values(), lengths) for k in range(at.shape[1]))):
                    height, width, ty, tx = (int(v[same[some[0]]]) for v in place)
                    kinds = [tuple(int(ints[c][k]) for c in _STRIP) for k in at[some[0]]]
                    channels = int(lengths[at[some[0], 0]]) // (kinds[0][2] * kinds[0][3])
                    side = tile + 2 * halo
                    step = max(1, _BLOCK // (channels * side * side))
                    for lo in range(0, len(some), step):
                        block = some[lo : lo + step]
                        both = np.zeros((2, len(block), channels, side, side))
                        for j, (top, left, high, wide) in enumerate(kinds):
                            y, x = top - ty * tile + halo, left - tx * tile + halo
                            for k, c in enumerate("ab"):
                                both[k, :, :, y : y + high, x : x + wide] = _stacked(parts[c], at[block, j]).reshape(len(block), channels, high, wide)
                        own = ssim_map(both[0], both[1])[:, :, halo : halo + min(tile, height - ty * tile), halo : halo + min(tile, width - tx * tile)]
                        total[same[block]], n[same[block]] = own.sum((1, 2, 3)), own[0].size
            yield pa.RecordBatch.from_arrays([rows.column("image"), pa.array(total), pa.array(n)], names=["image", "total", "n"])

    return run


def ssim_by_tiles(tiles: DataFrame, tile: int) -> DataFrame:
    """(image, ssim) from tiles of images: image (string), height, width, tile_y, tile_x, and arrays ``a`` and ``b``, channel after channel, of ``tile`` pixels on a side or what the frame has left.

    A tile gets the strips of its neighbours that its windows reach, so no task holds an image; sums join.
    """
    halo = SSIM_TAPS // 2
    columns = ["image", *[F.col(c).cast("int").alias(c) for c in _PLACE], *[F.col(c).cast("array<double>").alias(c) for c in "ab"]]
    ints = ", ".join(f"{c} int" for c in (*_PLACE, *_STRIP))
    spread = tiles.select(*columns).mapInArrow(_tiles_and_strips(tile, halo), f"image string, {ints}, a array<double>, b array<double>")
    gathered = spread.groupBy("image", *_PLACE).agg(F.array_sort(F.collect_list(F.struct(*_STRIP, "a", "b"))).alias("strips"))
    sums = gathered.mapInArrow(_ssim_of_tiles(tile, halo), "image string, total double, n long")
    return sums.groupBy("image").agg((F.sum("total") / F.sum("n")).alias("ssim"))


def cut_tiles(images: DataFrame, channels: int, height: int, width: int, tile: int) -> DataFrame:
    """Tiles, as ``ssim_by_tiles`` takes them, of rows (image, a, b) that hold whole images."""

    def part(v: str) -> Column:
        rows = F.sequence(F.col("tile_y") * tile, F.least(F.col("tile_y") * tile + tile, F.lit(height)) - 1)
        wide = F.least(F.lit(tile), F.lit(width) - F.col("tile_x") * tile)
        line = lambda c: F.flatten(F.transform(rows, lambda y: F.slice(v, c * height * width + y * width + F.col("tile_x") * tile + 1, wide)))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), line))

    at = lambda size: F.explode(F.sequence(F.lit(0), F.lit(-(-size // tile) - 1)))
    rows = images.select("image", "a", "b", F.lit(height).alias("height"), F.lit(width).alias("width")).withColumn("tile_y", at(height)).withColumn("tile_x", at(width))
    return rows.select("image", "height", "width", "tile_y", "tile_x", part("a").alias("a"), part("b").alias("b"))


def perceptual_distance(a: Column, b: Column, weights: Column, channels: int, positions: int) -> Column:
    """One layer's distance of stored features (channel after channel): unit length along the channels at each position, weighted squared differences, mean over positions."""
    at = lambda f, c, p: F.get(f, F.lit(c * positions) + p)

    def length(f: Column, p: Column) -> Column:
        total = at(f, 0, p) * at(f, 0, p)
        for c in range(1, channels):
            total = total + at(f, c, p) * at(f, c, p)
        return F.sqrt(total) + 1e-10

    def position(p: Column) -> Column:
        la, lb = length(a, p), length(b, p)
        out = F.lit(0.0)
        for c in range(channels):
            d = at(a, c, p) / la - at(b, c, p) / lb
            out = out + F.get(weights, F.lit(c)) * d * d
        return out

    return _mean(F.transform(F.sequence(F.lit(0), F.lit(positions - 1)), position))


def perceptual_sum(layers: list[tuple[Column, Column, Column, int, int]]) -> Column:
    """The distances of several layers' features (a, b, weights, channels, positions), added up."""
    out = [perceptual_distance(*layer) for layer in layers]
    return sum(out[1:], out[0])


def scene_metrics(views: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean over the views of a scene and method."""
    return views.groupBy("scene_id", "method").agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n_views"))


def metrics_rollup(views: DataFrame, metrics: list[str]) -> DataFrame:
    """By data set and scene, by data set, and over all. ``level``: 0, 1 or 3, the columns rolled up as bits."""
    return views.rollup("dataset", "scene_id").agg(F.grouping_id().cast("int").alias("level"), *[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n_views"))


def metrics_cube(views: DataFrame, metrics: list[str]) -> DataFrame:
    return views.cube("dataset", "method").agg(F.grouping_id().cast("int").alias("level"), *[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n_views"))


def validation_report(views: DataFrame) -> DataFrame:
    """Mean L1 and PSNR by ``split`` of scored views; a view that the sample of train views has twice counts twice."""
    return views.groupBy("split").agg(F.avg("l1").alias("l1"), F.avg("psnr").alias("psnr"), F.count(F.lit(1)).alias("n_views"))


def opacity_histogram(opacity: Column, primitives: DataFrame, bins: int = 30) -> DataFrame:
    """Primitives by scene and by ``bins`` equal steps of opacity from 0 to 1; bin 0 is the first."""
    step = F.least(F.floor(opacity * bins), F.lit(bins - 1)).cast("int")
    return primitives.groupBy("scene_id", step.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def total_points(primitives: DataFrame) -> DataFrame:
    return primitives.groupBy("scene_id").agg(F.count(F.lit(1)).alias("total_points"))


def model_stats(images: DataFrame, points: DataFrame) -> DataFrame:
    """Counts, mean observations of an image (unmatched ones count) and mean track length, by scene."""
    seen = images.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_images"), F.avg("n_observations").alias("mean_observations"))
    tracks = points.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_points"), F.avg("track_length").alias("mean_track_length"))
    return seen.join(tracks, "scene_id", "full_outer")


def stage_timings(log: DataFrame) -> DataFrame:
    """Minutes of each stage of each data set, from a log of seconds."""
    return log.groupBy("dataset", "stage").agg((F.sum("seconds") / 60).alias("minutes"), F.count(F.lit(1)).alias("n_jobs"))


def ema(losses: DataFrame, share: float = 0.4, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Each series' running mean ``share * x + (1 - share) * before``, from 0, at each row in order of (ts, event_id).

    A scan over range partitions, so that a long series has many tasks: each
    partition takes its part of a series from 0; how much of what came before is left
    after it falls by ``1 - share`` with each row, so the parts join by one number
    each. A null loss leaves the mean as it is. ``keep`` writes a table and gives it back.
    """
    keep = keep or keeper(losses.sparkSession, "ema")
    kinds = {f.name: f.dataType.simpleString() for f in losses.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, value, n = None, 0.0, 0
        for rows in batches:
            out, many = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
            names, x = rows["series"].to_numpy(), rows["loss"].astype(float)
            cuts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(rows) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(rows)], strict=True):
                if names[lo] != series:
                    series, value, n = names[lo], 0.0, 0
                part = x.iloc[lo:hi]
                out[lo:hi] = pd.concat([pd.Series([value]), part]).ewm(alpha=share, adjust=False, ignore_na=True).mean().to_numpy()[1:] if share < 1 else part.ffill().fillna(value)
                many[lo:hi] = n + part.notna().cumsum().to_numpy()
                value, n = float(out[hi - 1]), int(many[hi - 1])
            yield rows.assign(_local=out, _n=many)

    parts = int(losses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = losses.repartitionByRange(parts, "series", "ts", "event_id").sortWithinPartitions("series", "ts", "event_id").withColumn("_part", F.spark_partition_id())
    local = keep(ranged.mapInPandas(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", _part int, _local double, _n long"), "local")
    last = local.groupBy("series", "_part").agg(F.max_by("_local", F.struct("ts", "event_id", "_n")).alias("end"), F.max("_n").alias("n"))
    # One entry for each partition that holds rows of the series.
    ends = last.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("_part", "end", "n"))).alias("ends"))
    left = lambda n: F.pow(F.lit(1.0 - share), n)
    earlier = F.filter("ends", lambda e: e["_part"] < F.col("_part"))
    start = F.aggregate(earlier, F.lit(0.0), lambda v, e: e["end"] + left(e["n"]) * v)
    starts = last.join(ends, "series").select("series", "_part", start.alias("_start"))
    joined = local.join(starts, ["series", "_part"])
    return joined.withColumn("ema", F.col("_local") + left(F.col("_n")) * F.col("_start")).select(*losses.columns, "ema")


def composite(fragments: DataFrame, background: float = 0.0, key: tuple[str, ...] = ("scene_id", "view_id", "pixel"), least: float = 1 / 255, most: float = 0.99, stop: float = 1e-4, pixels: DataFrame | None = None) -> DataFrame:
    """Front-to-back blending of each pixel's fragments (depth, prim_id, alpha, red, green, blue) over ``background``.

    Alphas are at most ``most``; those under ``least`` don't count; none
    counts once less than ``stop`` would come through. Equal depths go by
    prim_id. ``pixels`` (the key, each once) are those of the frames: one
    without a fragment that counts is background. Without ``pixels`` they are
    those of any fragment.
    """
    alpha = F.least(F.col("alpha"), F.lit(most))
    by = W.partitionBy(*key).orderBy("depth", "prim_id")
    rows = fragments.filter(F.col("alpha") >= least).withColumn("_a", alpha)
    rows = rows.withColumn("_log", F.coalesce(F.sum(F.ln(1 - F.col("_a"))).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("_after", F.exp(F.col("_log")) * (1 - F.col("_a"))).filter(F.col("_after") >= stop)
    weight = F.exp(F.col("_log")) * F.col("_a")
    through = F.min("_after")
    out = [(F.sum(weight * F.col(c)) + background * through).alias(c) for c in ("red", "green", "blue")]
    blended = rows.groupBy(*key).agg(*out, F.sum(weight / F.col("depth")).alias("inverse_depth"), through.alias("transmittance"), F.count(F.lit(1)).alias("n_blended"))
    frame = fragments.select(*key).distinct() if pixels is None else pixels.select(*key)
    none = {**dict.fromkeys(("red", "green", "blue"), background), "inverse_depth": 0.0, "transmittance": 1.0, "n_blended": 0}
    return frame.join(blended, list(key), "left").fillna(none)
