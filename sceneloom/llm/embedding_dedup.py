"""Embedding near-duplicates by a pivot-permutation index.

Each vector is told by its nearest reference points (pivots) in order. It is
entered in the inverted lists of the first few of them. Vectors of a list that
share enough pivots of their permutations are candidates, and cosines in
double precision decide. Equal vectors are one item with a count.

A list longer than a block is dealt in blocks whose pairs are tasks. Where its
vectors crowd around a few of them, each within half the angle of a link, all of these
are linked with one another without being compared, so that a large group of
near copies costs in proportion to its size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

LEAST_COSINE = 0.9
#: Pivots: so many for each square root of the items, so that lists grow with that root. They are drawn
#: from a sample of twice as many items, the bound of what the driver and a broadcast hold of the vectors.
PIVOTS_PER_ROOT, LEAST_PIVOTS, SAMPLE = 2.0, 16, 2
#: Pivots that are at least so much alike are not told apart.
MOST_ALIKE = 0.5
#: Pivots of a permutation, how many of them have the vector in their lists, and how many two candidates share.
PERMUTATION, LISTS, SHARED = 12, 5, 2
#: Entries of a list in a block, and centres that are tried in a longer list.
BLOCK, CENTRES = 2048, 16
#: Rows of a block that are held against the other block at a time.
SLICE = 256


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Unit vectors in double precision; shorter ones end in zeros."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    # A large component would overflow when squared.
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def _fitted(a: np.ndarray, width: int) -> np.ndarray:
    return a[:, :width] if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def choose_pivots(items: DataFrame, n: int) -> np.ndarray:
    """Pivots out of the items whose hashes are least; of those much alike the first."""
    wanted = max(LEAST_PIVOTS, math.ceil(PIVOTS_PER_ROOT * math.sqrt(n)))
    drawn = items.select("item", "vec").orderBy(F.xxhash64("item"), "item").limit(SAMPLE * wanted).toPandas()
    vectors = _matrix(drawn["vec"]) if len(drawn) else np.zeros((0, 1))
    chosen: list[int] = []
    for k in range(len(vectors)):
        if len(chosen) < wanted and not (chosen and (vectors[chosen] @ vectors[k]).max() >= MOST_ALIKE):
            chosen.append(k)
    return vectors[chosen]


def permutations(items: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``items`` with ``near``: the numbers of each vector's PERMUTATION nearest pivots in order, of equally near ones the least first."""
    names = [f.name for f in items.schema if f.name != "near"]
    width, most = pivots.shape[1], min(PERMUTATION, len(pivots))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            near = np.zeros((len(rows), most), np.int32)
            for k in range(0, len(rows), SLICE):
                part = _matrix(rows["vec"].iloc[k : k + SLICE])
                # Pivots are given in their sample's width; components beyond it count for the length only.
                apart = -_fitted(part, width) @ pivots.T
                if most < len(pivots):
                    few = np.sort(np.argpartition(apart, most - 1, axis=1)[:, :most], axis=1)
                else:
                    few = np.tile(np.arange(most), (len(part), 1))
                order = np.argsort(np.take_along_axis(apart, few, 1), axis=1, kind="stable")
                near[k : k + SLICE] = np.take_along_axis(few, order, 1)
            yield rows.assign(near=list(near))

    return items.select(names).mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema if f.name != "near") + ", near array<int>")


def candidates(a: np.ndarray, b: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` (permutations) that have ``shared`` pivots or more in common, whatever their places.

    Counted along inverted lists of the pivots, or if these hold more entries than there are pairs, as a product of pivot tables.
    """
    known, codes = np.unique(b, return_inverse=True)
    codes = codes.reshape(b.shape)
    order = np.argsort(codes.ravel(), kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(codes.ravel(), minlength=len(known)))])
    at = np.searchsorted(known, a.ravel())
    at[at == len(known)] = 0
    hit = known[at] == a.ravel()
    rows, lists = np.flatnonzero(hit) // a.shape[1], at[hit]
    sizes = starts[lists + 1] - starts[lists]
    if (total := int(sizes.sum())) <= len(a) * len(b):
        within = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        pairs = np.repeat(rows, sizes) * len(b) + order[np.repeat(starts[lists], sizes) + within] // b.shape[1]
        pairs, counts = np.unique(pairs, return_counts=True)
        pairs = pairs[counts >= shared]
        return pairs // len(b), pairs % len(b)
    left, right = np.zeros((len(a), len(known)), np.float32), np.zeros((len(b), len(known)), np.float32)
    left[rows, lists] = 1
    right[np.repeat(np.arange(len(b)), b.shape[1]), codes.ravel()] = 1
    return np.nonzero(left @ right.T >= shared)


def _met_before(a: np.ndarray, b: np.ndarray, here: int) -> np.ndarray:
    """Whether rows of first pivots have one in common that is numbered below ``here``, so that the pair counts in its list."""
    out = np.zeros(len(a), bool)
    for k in range(a.shape[1]):
        out |= (a[:, k] < here) & (a[:, k, None] == b).any(1)
    return out


def _joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent``, a forest of roots, with the trees of each pair made one."""
    while len(a):
        a, b = parent[a], parent[b]
        a, b = a[a != b], b[a != b]
        least = np.minimum(a, b)
        np.minimum.at(parent, a, least)
        np.minimum.at(parent, b, least)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return parent


def _links(least: float, shared: int, lists: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Verifies one pair of a list's blocks: for each item that is linked the number of vectors, and an item that reaches it."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        here, i, j = key
        items, ball, times = rows["item"].to_numpy(), rows["ball"].to_numpy(), rows["n"].to_numpy()
        near, vectors = np.stack(rows["near"].to_list()), _matrix(rows["vec"])
        left = np.flatnonzero(rows["block"].to_numpy() == i)
        right = np.flatnonzero(rows["block"].to_numpy() == j)
        total, parent = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for k in range(0, len(left), SLICE):
            a, b = candidates(near[left[k : k + SLICE]], near[right], shared)
            a, b = left[k + a], right[b]
            fresh = (ball[a] < 0) | (ball[a] != ball[b])
            fresh &= items[a] < items[b] if i == j else True
            a, b = a[fresh], b[fresh]
            fresh = ~_met_before(near[a, :lists], near[b, :lists], here)
            a, b = a[fresh], b[fresh]
            linked = np.zeros(len(a), bool)
            for m in range(0, len(a), 1 << 15):
                linked[m : m + (1 << 15)] = np.einsum("ij,ij->i", vectors[a[m : m + (1 << 15)]], vectors[b[m : m + (1 << 15)]]) >= least
            a, b = a[linked], b[linked]
            np.add.at(total, a, times[b])
            np.add.at(total, b, times[a])
            parent = _joined(parent, a, b)
        found = np.flatnonzero(total)
        return pd.DataFrame({"item": items[found], "links": total[found], "root": items[parent[found]]})

    return run


def _first_within(cosine: float):
    """The first of a row's centres (flat, of the vector's width) whose cosine is greater, -1 without any."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vectors, centres in batches:
            out = np.full(len(vectors), -1, np.int32)
            for k, (v, c) in enumerate(zip(vectors, centres, strict=True)):
                near = np.flatnonzero(_matrix(pd.Series(c)) @ _fitted(_matrix(pd.Series([v])), max(map(len, c)))[0] > cosine)
                out[k] = near[0] if len(near) else -1
            yield pd.Series(out)

    return run


def balls(entries: DataFrame, counts: DataFrame, least: float, block: int, centres: int) -> DataFrame:
    """(item, ball): items of lists longer than ``block`` that stand within half the angle of a link of a centre, the least one they meet.

    Any two of a ball are linked, as the two angles add up to no more than a
    link's. Centres are about ``centres`` entries of each such list, by hash.
    """
    crowded = counts.filter(F.col("entries") > block)
    rows = entries.join(crowded, "list")
    drawn = rows.filter(F.pmod(F.xxhash64("item"), F.ceil(F.col("entries") / centres)) == 0).groupBy("list").agg(F.array_sort(F.collect_list(F.struct("item", "vec"))).alias("centres"))
    # Rounding must not make two of a ball that are no link.
    half = math.cos(math.acos(least) / 2) + 1e-9
    first = F.pandas_udf(_first_within(half), "int")
    met = rows.select("list", "item", "vec").join(drawn, "list").select("item", F.get("centres.item", first("vec", "centres.vec")).alias("ball"))
    return met.groupBy("item").agg(F.min("ball").alias("ball")).filter("ball IS NOT NULL")


def item_links(items: DataFrame, scratch: Scratch, least: float = LEAST_COSINE, shared: int = SHARED, lists: int = LISTS, block: int = BLOCK, centres: int = CENTRES) -> DataFrame:
    """(item, links, root): vectors that each linked item of ``items`` (item, vec, n) is linked with, and an item that it reaches, in parts that add up."""
    pivots = choose_pivots(items, items.count())
    if not len(pivots):
        return items.sparkSession.createDataFrame([], "item long, links long, root long")
    described = scratch.keep(permutations(items, pivots), "described")
    entries = described.withColumn("list", F.explode(F.slice("near", 1, lists)))
    counts = scratch.keep(entries.groupBy("list").agg(F.count(F.lit(1)).alias("entries")), "lists")
    found = scratch.keep(balls(entries, counts, least, block, centres), "balls")
    # A ball that fills a block in a list has blocks of its own there; what is left is dealt together.
    entries = entries.join(found, "item", "left").withColumn("ball", F.coalesce("ball", F.lit(-1)))
    units = entries.groupBy("list", "ball").agg(F.count(F.lit(1)).alias("m"))
    large = (F.col("ball") >= 0) & (F.col("m") >= block)
    own = scratch.keep(units.groupBy("list", F.when(large, F.col("ball")).otherwise(-1).alias("unit")).agg(F.ceil(F.sum("m") / block).cast("int").alias("blocks")), "units")
    dealt = own.groupBy("list").agg(F.array_sort(F.collect_list(F.struct("unit", "blocks"))).alias("all"))
    entries = entries.join(dealt, "list")
    entries = entries.withColumn("unit", F.when(F.array_contains("all.unit", F.col("ball")), F.col("ball")).otherwise(F.lit(-1)))
    before = lambda unit: F.aggregate(F.filter("all", lambda u: u["unit"] < unit), F.lit(0), lambda s, u: s + u["blocks"])
    blocks = F.get(F.filter("all", lambda u: u["unit"] == F.col("unit")), F.lit(0))["blocks"]
    entries = entries.withColumn("block", before(F.col("unit")) + F.pmod(F.xxhash64("item", "list"), blocks).cast("int"))
    # Blocks of one ball don't meet.
    others = F.flatten(F.transform(F.filter("all", lambda u: (u["unit"] < 0) | (u["unit"] != F.col("unit"))), lambda u: F.sequence(before(u["unit"]), before(u["unit"]) + u["blocks"] - 1)))
    met = entries.withColumn("other", F.explode(others)).select("list", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "item", "ball", "n", "near", "vec")
    checked = met.groupBy("list", "i", "j").applyInPandas(_links(least, shared, lists), "item long, links long, root long")
    balled = items.join(found, "item")
    inside = balled.groupBy("ball").agg(F.sum("n").alias("all"), F.min("item").alias("root"))
    return checked.unionByName(balled.join(inside, "ball").select("item", (F.col("all") - F.col("n")).alias("links"), "root"))


def near_duplicates(vectors: DataFrame, scratch: Scratch, least: float = LEAST_COSINE, **limits: int) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, embedding).

    ``n_links``: other rows found whose cosine is ``least`` or more;
    ``component_id``: the least vec_id that is reached by links; ``kept``
    where that is the row's own. Each pair found is verified or lies in a
    ball; which pairs are found rests on the permutations, so few near ``least`` may be missed.
    Rows that are null, empty, all zeros or hold a null or a number that is not
    finite link with nothing. Shorter vectors count as ending in zeros. Equal
    vectors and repeated rows link with each other. A null vec_id is never
    the least; without any other in its component the row is kept. Other columns are not
    read, whatever their names. An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    fine = F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("vec", lambda x: x != 0)
    keyed = rows.select("vec_id", F.when(fine, F.col("vec")).alias("vec"), F.when(fine, F.xxhash64("vec")).alias("h1"), F.when(fine, F.xxhash64(F.lit(1), F.reverse("vec"))).alias("h2"))
    # Vectors are told apart by 128 bits of hashes.
    equal = keyed.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.any_value("vec").alias("vec"))
    items = scratch.keep(equal.withColumn("item", F.monotonically_increasing_id()), "items")
    found = scratch.keep(item_links(items.select("item", "vec", "n"), scratch, least, **limits), "links")
    roots = components(found.select(F.col("item").alias("a"), F.col("root").alias("b")), scratch).withColumnRenamed("node", "item")
    links = found.groupBy("item").agg(F.sum("links").alias("links"))
    known = items.select("item", "h1", "h2", "n", "least").join(links, "item", "left").join(roots, "item", "left").withColumn("root", F.coalesce("root", "item"))
    known = scratch.keep(known, "known")
    ids = known.groupBy("root").agg(F.min("least").alias("component"))
    told = known.join(ids, "root").select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    out = keyed.drop("vec").join(told, ["h1", "h2"], "left")
    component = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
