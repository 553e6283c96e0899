"""Small column rules: sizes, names, schedules, scores."""

from __future__ import annotations

import math

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def working_resolution(width: Column, height: Column, resolution: int = -1, scale: float = 1.0) -> tuple[Column, Column]:
    """Size at which an image is used. 1, 2, 4, 8 divide and round halves to even; -1 caps the width at 1600; others are a target width; both of these cut."""
    if resolution in (1, 2, 4, 8):
        return tuple(F.bround(v / (scale * resolution)).cast("int") for v in (width, height))
    down = F.greatest(width / 1600, F.lit(1.0)) if resolution == -1 else width / float(resolution)
    return tuple((v / (down * scale)).cast("int") for v in (width, height))


def image_stem(name: Column) -> Column:
    """Up to the last dot; empty without one."""
    return F.regexp_extract(name, r"(?s)^(.*)\.[^.]*$", 1)


def apply_depth_affine(depth: Column, scale: Column, offset: Column) -> Column:
    """Negative depths become 0 first; a positive scale then applies."""
    floor = F.greatest(depth, F.lit(0.0))
    return F.when(scale > 0, floor * scale + offset).otherwise(floor)


def half_frame(pixels: Column, width: Column) -> Column:
    """The right half of a row-major frame: columns from width // 2 on."""
    return F.filter(pixels, lambda _, i: i % width >= F.floor(width / 2))


def half_size(pixels: Column, height: int, width: int) -> Column:
    """A row-major image of even sides at half its size, by the mean of each 2x2."""
    w = width // 2

    def mean(i: Column) -> Column:
        at = F.floor(i / w).cast("int") * 2 * width + (i % w) * 2
        corners = [F.get(pixels, at + d) for d in (0, 1, width, width + 1)]
        return (corners[0] + corners[1] + corners[2] + corners[3]) / 4

    return F.transform(F.sequence(F.lit(0), F.lit(height // 2 * w - 1)), mean)


def resize_pyramid(pixels: Column, height: int, width: int, levels: int = 3) -> list[Column]:
    """The image at a half, a quarter, an eighth and so on."""
    out = []
    for _ in range(levels):
        pixels = half_size(pixels, height, width)
        out.append(pixels)
        height, width = height // 2, width // 2
    return out


@lru_cache(maxsize=256)
def area_weights(size: int, to: int) -> np.ndarray:
    """(to, size): the share of each of ``size`` cells in each of ``to`` that cover the same length."""
    step = size / to
    low, high = np.arange(to)[:, None] * step, (np.arange(to)[:, None] + 1) * step
    return np.maximum(np.minimum(high, np.arange(size) + 1) - np.maximum(low, np.arange(size)), 0) / step


def resized(pixels: Column, height: Column, width: Column, to_height: Column, to_width: Column) -> Column:
    """Row-major images, channel after channel, at any other size: each new pixel is the mean of the area that it covers.

    Sizes may differ from row to row; weights are worked out once for each pair of sizes, and rows and columns are weighed apart.
    A null in any argument gives null.
    """

    @F.pandas_udf("array<double>")
    def run(v: pd.Series, h: pd.Series, w: pd.Series, th: pd.Series, tw: pd.Series) -> pd.Series:
        out = []
        for image, *sizes in zip(v, h, w, th, tw, strict=True):
            if image is None or any(pd.isna(x) for x in sizes):
                out.append(None)
                continue
            a, b, c, d = map(int, sizes)
            planes = np.asarray(image, float).reshape(-1, a, b)
            out.append((area_weights(a, c) @ planes @ area_weights(b, d).T).ravel())
        return pd.Series(out, dtype=object)

    return run(pixels, height, width, to_height, to_width)


def expon_decay(step: Column, first: float, last: float, delay_steps: int = 0, delay_mult: float = 1.0, steps: int = 1_000_000) -> Column:
    """Log-linear from ``first`` to ``last``, eased in by a sine over ``delay_steps``; 0 before step 0 or if both ends are 0."""
    if first == 0 and last == 0:
        return F.lit(0.0)
    share = lambda n: F.least(F.greatest(step / float(n), F.lit(0.0)), F.lit(1.0))
    ease = delay_mult + (1 - delay_mult) * F.sin(math.pi / 2 * share(delay_steps)) if delay_steps > 0 else F.lit(1.0)
    return F.when(step < 0, 0.0).otherwise(ease * F.exp(math.log(first) * (1 - share(steps)) + math.log(last) * share(steps)))


def combined_score(l1: Column, ssim: Column, weight: float = 0.2) -> Column:
    return (1 - weight) * l1 + weight * (1 - ssim)


def densify_schedule(iteration: Column, first: int = 500, last: int = 15_000, every: int = 100, reset_every: int = 3_000, white: bool = False) -> dict[str, Column]:
    """What is done to the primitive table after an iteration."""
    active = iteration < last
    reset = iteration % reset_every == 0
    if white:
        reset = reset | (iteration == first)
    return {"densify": active & (iteration > first) & (iteration % every == 0), "size_rule": iteration > reset_every, "reset": active & reset}
