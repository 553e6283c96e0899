"""Removal of repeated byte strings with a sparse suffix array, range-partitioned.

Only suffixes at chosen places are sorted. A place is chosen if the hash of
the ``GRAM`` bytes from there is the least of some ``length``-byte string
around it; so each such string holds a chosen place, the same one in each of
its copies. Places whose bytes are found nowhere else drop out. Of the
others the bytes around travel, once for each different context, to buckets
cut by sampled splitters on the leading bytes; a bucket's suffixes are sorted
by multikey quicksort, 8 bytes a key, the lengths shared with the neighbours
to the right and, sorted backwards, to the left tell which strings around a
place are found again. Splitters never part suffixes with equal leading ``GRAM``
bytes, so no shared string lies across a boundary. A gram of more contexts than
a bucket may hold is parted by longer grams, with half the strings each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LENGTH = 200
GRAM = 80
#: Different contexts of one gram that one task compares; more are parted by longer grams first.
HOT = 4_000
#: Texts with repeated places whose keys may be broadcast to the scan; beyond, all texts are shuffled.
BROADCAST_TEXTS = 500_000
_BATCH = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_TASK_ROWS = 50_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _sliding(op: np.ufunc, a: np.ndarray, w: int) -> np.ndarray:
    out, span = a, 1
    while span * 2 <= w:
        out, span = op(out[:-span], out[span:]), span * 2
    n = len(a) - w + 1
    return op(out[:n], out[w - span : w - span + n])


def chosen_places(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, place in it, hash of the gram) for all chosen places of texts that have ``length`` bytes or more."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n, w = len(data) - gram + 1, length - gram + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _powers(1 << len(data).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:n]) * down[:n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    np.maximum(h, np.uint64(1), out=h)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    least = _sliding(np.minimum, h, w)
    # A string that runs over its text's end chooses nothing.
    inside = np.zeros(len(least) + 1, np.int32)
    ok = sizes >= length
    np.add.at(inside, starts[ok], 1)
    np.add.at(inside, np.minimum((starts + sizes - length + 1)[ok], len(least)), -1)
    least[np.cumsum(inside[:-1]) == 0] = 0
    most = _sliding(np.maximum, np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]), w)
    at = np.flatnonzero(most == h)
    doc = np.searchsorted(starts, at, side="right") - 1
    return doc, at - starts[doc], h[at]


def _batched(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _BATCH bytes."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= _BATCH:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _places(length: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [bytes(t) for t in rows["text"]]
            a, b = rows["a"].to_numpy(np.int64), rows["b"].to_numpy(np.int64)
            for i, j in _batched(texts):
                doc, pos, h = chosen_places(texts[i:j], length, gram)
                yield pd.DataFrame({"a": a[i:j][doc], "b": b[i:j][doc], "pos": pos, "gram": h.view(np.int64)})

    return run


def _frames(rows: Iterator[tuple], names: dict[str, str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of up to _TASK_ROWS rows."""
    while part := list(islice(rows, _TASK_ROWS)):
        yield pd.DataFrame(dict(zip(names, zip(*part, strict=True), strict=True))).astype(names)


def _contexts(length: int, gram: int):
    side = length - gram

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for rows in batches:
            for a, b, text, places in zip(rows["a"], rows["b"], rows["text"], rows["places"], strict=True):
                text = bytes(text)
                for p in sorted(places):
                    left = min(p, side)
                    yield a, b, p, left, xxhash.xxh64_intdigest(text[p : p + gram]) >> 1, text[p - left : p + length]

    return lambda batches: _frames(each(batches), {"a": "int64", "b": "int64", "pos": "int64", "left": "int32", "gram": "int64", "ctx": "object"})


def multikey_order(words: np.ndarray) -> np.ndarray:
    """The order of rows of big-endian words, by multikey quicksort; equal rows keep their order.

    A segment of rows that agree so far is parted by one word into those
    less than, equal to and greater than a pivot; the equal ones go on with
    the next word, the others with the same. All segments are parted at a
    time; one of a single row, or past its last word, is done.
    """
    n, width = words.shape
    order = np.arange(n)
    # Where each segment that isn't done begins, its length and the word that parts it.
    begin, length, depth = (np.array([x], np.int64) for x in (0, n, 0))
    if not width:
        return order
    while len(begin := begin[(keep := (length > 1) & (depth < width))]):
        length, depth = length[keep], depth[keep]
        segment = np.repeat(np.arange(len(begin)), length)
        first = np.cumsum(length) - length
        at = np.arange(len(segment)) - first[segment] + begin[segment]
        value = words[order[at], depth[segment]]
        # The middle one of three is the pivot.
        three = np.sort(np.stack([value[first], value[first + length // 2], value[first + length - 1]]), axis=0)[1]
        pivot = three[segment]
        part = (value > pivot).astype(np.int64) - (value < pivot) + 1
        counts = np.bincount(segment * 3 + part, minlength=3 * len(begin))
        # A stable place for each row: its part's begin and its number in it.
        by = np.argsort(segment * 3 + part, kind="stable")
        order[at] = order[at[by]]
        begins = np.repeat(begin, 3) + (np.cumsum(counts) - counts - np.repeat(first, 3))
        begin, length, depth = begins, counts, np.repeat(depth, 3)
        depth[1::3] += 1
    return order


def _order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of zero-padded byte rows, and the bytes each shares with the one before it (-1 for the first)."""
    order = multikey_order(rows.view(">u8").astype(np.uint64))
    same = rows[order][1:] == rows[order][:-1]
    shared = np.where(same.all(1), rows.shape[1], same.argmin(1))
    return order, np.concatenate([[-1], shared])


def found_again(contexts: list[bytes], grams: np.ndarray, left: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each different context the least and the most bytes left of its place that a string found in another one of its gram starts at.

    (``length``, -1) if there is none. ``grams`` are numbers, the first key. A string that starts o bytes to the
    left is shared by those that share ``length - o`` bytes rightwards and o
    leftwards.
    """
    m, side = len(contexts), length - gram
    right = np.zeros((m, 8 - (-length // 8) * 8), np.uint8)
    right[:, :8] = grams.astype(">i8").view(np.uint8).reshape(m, 8)
    before = np.zeros((m, max(8, -(-side // 8) * 8)), np.uint8)
    for k, (c, n) in enumerate(zip(contexts, left.tolist(), strict=True)):
        right[k, 8 : 8 + len(c) - n] = np.frombuffer(c, np.uint8)[n:]
        before[k, :n] = np.frombuffer(c, np.uint8)[:n][::-1]
    there = np.array([len(c) for c in contexts], np.int64) - left
    to_right, shared_right = _order(right)
    to_left, shared_left = _order(before)
    low, high = np.full(m, length, np.int64), np.full(m, -1, np.int64)
    by_right, by_left = np.empty(m, np.int64), np.empty(m, np.int64)
    for o in range(side + 1):
        by_right[to_right] = np.cumsum(shared_right - 8 < length - o)
        by_left[to_left] = np.cumsum(shared_left < o)
        rows = np.flatnonzero((left >= o) & (there >= length - o))
        key = by_right[rows] * (m + 1) + by_left[rows]
        order = np.argsort(key, kind="stable")
        twin = key[order][1:] == key[order][:-1]
        hit = rows[order[np.concatenate([[False], twin]) | np.concatenate([twin, [False]])]] if len(rows) else rows
        low[hit] = np.minimum(low[hit], o)
        high[hit] = o
    return low, high


def _compare(length: int, gram: int):
    """Over rows that are sorted by gram: whole grams at a time, of about _TASK_ROWS rows."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        left = rows["left"].to_numpy(np.int64)
        low, high = found_again([bytes(c) for c in rows["ctx"]], rows["gram"].to_numpy(np.int64), left, length, gram)
        # A context found twice as a whole has all its strings again.
        there = rows["ctx"].map(len).to_numpy(np.int64) - left
        whole = (rows["n"].to_numpy(np.int64) > 1) & (left + there >= length)
        low = np.where(whole, np.maximum(length - there, 0), low)
        high = np.where(whole, np.minimum(left, length - gram), high)
        return pd.DataFrame({"c1": rows["c1"], "c2": rows["c2"], "low": low, "high": high})[high >= 0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in batches:
            held.append(rows)
            if sum(map(len, held)) < _TASK_ROWS:
                continue
            rows = pd.concat(held)
            open_gram = rows["gram"].to_numpy() == rows["gram"].iloc[-1]
            if not open_gram.all():
                yield solve(rows[~open_gram])
                rows = rows[open_gram]
            held = [rows]
        if held and len(rows := pd.concat(held)):
            yield solve(rows)

    return run


def _longer(length: int, gram: int):
    """Each context under two longer cores, which halve the strings around it: those that start up to ``half`` bytes left of its place, and the others."""
    side = length - gram
    half = side // 2

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for rows in batches:
            for p1, p2, n, gram, left, ctx in zip(rows["c1"], rows["c2"], rows["n"], rows["gram"], rows["left"], rows["ctx"], strict=True):
                ctx = bytes(ctx)
                for shift in (0, side - half):
                    place, core = left - shift, length - half
                    # A core that runs over the text's begin or end holds no string.
                    if place >= 0 and place + core <= len(ctx):
                        before = min(place, half)
                        # Two places may have one core, at different shifts: the gram tells them apart, or a string would be its own copy.
                        longer = xxhash.xxh64_intdigest(ctx[place : place + core], seed=gram + shift) >> 1
                        yield p1, p2, shift, n, before, longer, ctx[place - before : place + length]

    return lambda batches: _frames(each(batches), {"p1": "int64", "p2": "int64", "shift": "int32", "n": "int64", "left": "int32", "gram": "int64", "ctx": "object"})


def _answers(contexts: DataFrame, scratch: Scratch, length: int, gram: int, hot: int, level: int = 0) -> DataFrame:
    """c1, c2, low and high of all contexts that share a string with another one, or with a copy of theirs.

    ``contexts`` has n for the occurrences of each row. A gram of up to
    ``hot`` different contexts is compared in one bucket; more are parted by
    longer cores, of which each holds half of the strings around a place, and
    their answers brought back. The contexts that a core leaves are shorter,
    so more of them are equal; a core of ``length`` bytes has a single one.
    """
    different = contexts.groupBy("gram", "left", "ctx", "c1", "c2").agg(F.sum("n").alias("n"))
    different = scratch.keep(different, f"different{level}")
    sizes = different.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("most")).filter("m > 1 OR most > 1")
    sizes = scratch.keep(sizes, f"sizes{level}")
    few, many = sizes, sizes.filter(F.col("m") > hot).select("gram")
    parted = gram < length and not many.isEmpty()
    if parted:
        few = sizes.filter(F.col("m") <= hot)
    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leading = F.substring(F.col("ctx"), F.col("left") + 1, F.lit(gram))
    few = different.join(few.select("gram"), "gram").withColumn("leading", leading)
    few = few.repartitionByRange(parts, "leading").sortWithinPartitions("leading", "gram").drop("leading")
    answers = few.mapInPandas(_compare(length, gram), "c1 long, c2 long, low long, high long")
    if not parted:
        return answers
    crowded = different.join(many, "gram").select("c1", "c2", "n", "gram", "left", "ctx")
    longer = crowded.mapInPandas(_longer(length, gram), "p1 long, p2 long, shift int, n long, left int, gram long, ctx binary")
    longer = scratch.keep(longer.withColumns(_context_keys()), f"longer{level}")
    found = _answers(longer, scratch, length, length - (length - gram) // 2, hot, level + 1)
    back = longer.select("p1", "p2", "shift", "c1", "c2").join(found, ["c1", "c2"]).groupBy(F.col("p1").alias("c1"), F.col("p2").alias("c2"))
    return answers.unionByName(back.agg(F.min(F.col("low") + F.col("shift")).alias("low"), F.max(F.col("high") + F.col("shift")).alias("high")))


def _context_keys() -> dict[str, Column]:
    """Two hashes of 64 bits stand for a context."""
    return {"c1": F.xxhash64("ctx", "left", "gram"), "c2": F.xxhash64(F.lit(1), "ctx", "left", "gram")}


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for a, b, text, spans in zip(rows["a"], rows["b"], rows["text"], rows["spans"], strict=True):
            text, kept, at, removed, runs = bytes(text), hashlib.sha256(), 0, 0, 0
            for s, e in sorted((x["s"], x["e"]) for x in spans):
                if s > at or not runs:
                    kept.update(text[at:s])
                    runs, at = runs + 1, s
                if e > at:
                    removed, at = removed + e - at, e
            kept.update(text[at:])
            out.append((a, b, removed, runs, kept.hexdigest()))
        yield pd.DataFrame(out, columns=["a", "b", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of ``docs``.

    Removed is each byte covered by a ``length``-byte string that starts
    anywhere else too, in the same text or another. Null texts are empty;
    texts under ``length`` bytes lose nothing. Rows of equal text, repeated
    rows among them, lose all of it from ``length`` bytes on. An empty table
    gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    # Two hashes of 64 bits stand for a text.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    rows = scratch.keep(keyed.select("doc_id", "a", "b", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "rows")
    long = keyed.filter(F.octet_length("text") >= length).select("a", "b", "text")
    places = scratch.keep(long.mapInPandas(_places(length, gram), "a long, b long, pos long, gram long"), "places")
    # Two different occurrences, not two copies of one text, make a gram repeated.
    one = F.xxhash64("a", "pos")
    grams = places.groupBy("gram").agg(F.min(one).alias("x"), F.max(one).alias("y")).filter("x < y").select("gram")
    # Written, so that the join may be split where one gram has very many places.
    grams = scratch.keep(grams, "grams")
    repeated = places.join(grams, "gram").groupBy("a", "b").agg(F.collect_set("pos").alias("places"))
    repeated = scratch.keep(repeated, "repeated")
    if repeated.count() <= BROADCAST_TEXTS:
        long = long.join(F.broadcast(repeated.select("a", "b")), ["a", "b"], "left_semi")
    texts = scratch.keep(long.dropDuplicates(["a", "b"]).join(repeated, ["a", "b"]), "texts")
    scratch.drop("places")
    contexts = texts.mapInPandas(_contexts(length, gram), "a long, b long, pos long, left int, gram long, ctx binary")
    contexts = scratch.keep(contexts.withColumns(_context_keys()), "contexts")
    answers = _answers(contexts.withColumn("n", F.lit(1).cast("long")), scratch, length, gram, hot)
    span = F.struct((F.col("pos") - F.col("high")).alias("s"), (F.col("pos") - F.col("low") + length).alias("e"))
    spans = contexts.select("a", "b", "pos", "c1", "c2").join(answers, ["c1", "c2"]).groupBy("a", "b").agg(F.collect_set(span).alias("spans"))
    cut = texts.select("a", "b", "text").join(spans, ["a", "b"]).mapInPandas(_cut, "a long, b long, n_removed long, n_spans long, kept_sha256 string")
    cut = scratch.keep(cut, "cut")
    copies = rows.filter(F.col("n_bytes") >= length).groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("a", "b", F.lit(True).alias("copied"))
    known = copies.join(cut, ["a", "b"], "full_outer")
    out = rows.join(known, ["a", "b"], "left")
    pick = lambda copied, found, else_: F.when(F.col("copied"), copied).otherwise(F.coalesce(F.col(found), else_)).alias(found)
    return out.select("doc_id", "n_bytes", pick(F.col("n_bytes"), "n_removed", F.lit(0)), pick(F.lit(1).cast("long"), "n_spans", F.lit(0)), pick(F.lit(EMPTY_SHA), "kept_sha256", F.col("sha")))
