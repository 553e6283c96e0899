"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

An item's rarest 3-grams, by the documents and items that hold them, seed the
search. A join of seeds with the documents' 3-grams gives pairs of a text and
an item; the text's passages around the item's seeds are aligned with it word
by word, so that edited copies score nearly as high as exact ones. Items stay
in tables: the driver holds a bitmap of fixed size, by which most 3-grams of
the documents are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

SEED_WORDS = 3
#: Items of fewer words than these are seeded by pairs of words, as few 3-grams of theirs outlive an edit.
FEW_WORDS, FEW_SEED_WORDS = 8, 2
#: The share of an item's different seeds that are used, the rarest ones, and how many at least.
SEED_SHARE, LEAST_SEEDS = 0.75, 24
MATCH, MISMATCH, GAP = 2, -1, -1
#: Score, as a share of the item's score with itself, from which a passage counts as a copy.
LEAST_SCORE = 0.5
#: The least score of a copy, unless the whole item is worth less: four words in a row.
FLOOR = 8
#: Bits of the map of the items' seeds: 8 MB, whatever the benchmark holds.
MAP_BITS = 26
#: Seeds, and pairs' texts, that may be broadcast; beyond, joins shuffle. Items may be by the bytes of their words.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 1 << 25
#: Pairs of a text and an item that are aligned as one group.
PAIRS = 2048
#: Words whose numbers a task keeps at hand.
_KEPT_WORDS = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"\w+")


def words_in(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def least_score(n: int, least: float = LEAST_SCORE) -> float:
    """The score from which a passage counts as a copy of an item of ``n`` words: one law for all lengths."""
    return min(MATCH * n, max(least * MATCH * n, FLOOR))


class _Numbers(dict):
    """64-bit numbers of words, the same in all tasks."""

    def __missing__(self, word: str) -> int:
        number = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return number

    def of(self, text: str | None) -> np.ndarray:
        if len(self) > _KEPT_WORDS:
            self.clear()
        words = words_in(text)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def seed_width(n: int) -> int:
    """Words of a seed of an item of ``n`` words."""
    return SEED_WORDS if n >= FEW_WORDS else min(n, FEW_SEED_WORDS)


def _grams(w: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` words in a row."""
    n = max(len(w) - width + 1, 0)
    out = np.full(n, width, np.uint64)
    for k in range(width if n else 0):
        out = (out ^ w[k : n + k]) * _MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment: its score, and the end in ``passage``. Of equal ones the first end."""
    steps = np.arange(len(passage) + 1) * -GAP
    above, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for w in item:
        row = np.maximum(above + GAP, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(passage == w, MATCH, MISMATCH))
        # A gap in the item costs its length: the best of all that stand to the left, each less its distance.
        row = np.maximum.accumulate(row + steps) - steps
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
        above = row
    return best, end


class _Text:
    """A text's words as numbers, and the places of its n-grams in their order."""

    def __init__(self, w: np.ndarray):
        self.words, self.sorted = w, {}

    def starts(self, item: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        """Where the item would begin, by each place of one of its ``seeds``, in order."""
        width = seed_width(len(item))
        if width not in self.sorted:
            keys = _grams(self.words, width)
            order = np.argsort(keys, kind="stable")
            self.sorted[width] = keys[order], order
        keys, order = self.sorted[width]
        mine = _grams(item, width)
        at = np.flatnonzero(np.isin(mine, seeds))
        low, high = np.searchsorted(keys, mine[at]), np.searchsorted(keys, mine[at], "right")
        return np.unique(np.concatenate([order[a:b] - q for q, a, b in zip(at, low, high, strict=True)] or [order[:0]]))

    def best(self, item: np.ndarray, seeds: np.ndarray, least: float) -> tuple[float, int, int] | None:
        """(score, first word, word after the last) of the best passage, if it is a copy."""
        starts, n = self.starts(item, seeds), len(item)
        if not len(starts):
            return None
        slack, needed, best = n // 3 + 3, least_score(n, least), (0, 0, 0)
        # Starts whose passages overlap are of one run.
        cuts = np.flatnonzero(np.diff(starts) > n + 2 * slack) + 1
        for run in np.split(starts, cuts):
            a = max(int(run[0]) - slack, 0)
            passage = self.words[a : int(run[-1]) + n + slack]
            # No alignment scores more than the item's words that the passage has.
            if MATCH * np.isin(item, passage).sum() < needed:
                continue
            score, end = align(item, passage)
            if score > best[0]:
                _, length = align(item[::-1], passage[:end][::-1])
                best = (score, a + end - length, a + end)
        return (best[0] / (MATCH * n), best[1], best[2]) if best[0] >= needed else None


def _key(text: Column) -> Column:
    """What a text is told by in joins."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _few(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def _numbered_items(benchmark: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(item, text) of the different texts; and (item, words, width, keys) of those that have words, with their different seeds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = _Numbers()
        for rows in batches:
            words = [numbers.of(t) for t in rows["text"]]
            widths = [seed_width(len(w)) for w in words]
            keys = [np.unique(_grams(w, k)) if k else np.zeros(0, np.int64) for w, k in zip(words, widths, strict=True)]
            yield pd.DataFrame({"item": rows["item"], "words": [w.tobytes() for w in words], "width": widths, "keys": keys})

    texts = benchmark.select("text").filter(F.col("text").isNotNull()).distinct()
    texts = scratch.keep(texts.withColumn("item", F.monotonically_increasing_id()), "item_texts")
    items = texts.mapInPandas(run, "item long, words binary, width int, keys array<long>")
    return texts, scratch.keep(items.filter("width > 0"), "items")


def _seed_map(grams: DataFrame, bits: int) -> np.ndarray:
    """A bit for each value of a key's last ``bits``: set if some item has such a key. At most 2**(bits - 6) rows of 8 bytes come to the driver."""
    place = grams.select(F.col("key").bitwiseAND(F.lit((1 << bits) - 1)).alias("p"))
    rows = place.groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(max(1, (1 << bits) >> 6), np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def _hits(docs: DataFrame, grams: DataFrame, bits: int) -> DataFrame:
    """(text, key): n-grams of each row's text that some item may have, once a row."""
    widths = sorted(r.width for r in grams.select("width").distinct().collect())
    known, mask = _seed_map(grams, bits), np.int64((1 << bits) - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = _Numbers()
        for rows in batches:
            found = []
            for text in rows["text"]:
                w = numbers.of(text)
                keys = np.concatenate([_grams(w, k) for k in widths] or [np.zeros(0, np.int64)])
                p = keys & mask
                found.append(np.unique(keys[(known[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1]))
            yield pd.DataFrame({"text_key": rows["text_key"], "keys": found})

    rows = docs.select(_key(F.col("text")).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "text_key binary, keys array<long>").select("text_key", F.explode("keys").alias("key"))


def _seeds(grams: DataFrame, hits: DataFrame, share: float, at_least: int) -> DataFrame:
    """(item, key): each item's rarest n-grams, by the rows times the items that hold them, if any row does."""
    held = hits.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    weighed = grams.groupBy("key").agg(F.count(F.lit(1)).alias("items")).join(held, "key", "left")
    weight = F.coalesce("rows", F.lit(0)) * F.col("items")
    ranked = grams.join(weighed.select("key", "rows", weight.alias("weight")), "key")
    of = W.partitionBy("item")
    ranked = ranked.withColumns({"rank": F.row_number().over(of.orderBy("weight", "key")), "n": F.count(F.lit(1)).over(of)})
    return ranked.filter((F.col("rank") <= F.greatest(F.lit(at_least), F.ceil(F.col("n") * share))) & F.col("rows").isNotNull()).select("item", "key")


def candidates(docs: DataFrame, items: DataFrame, scratch: Scratch, bits: int = MAP_BITS, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(text_key, item) of texts that hold a seed of an item, each once; and the seeds (item, key)."""
    grams = scratch.keep(items.select("item", "width", F.explode("keys").alias("key")), "grams")
    hits = scratch.keep(_hits(docs, grams, bits), "hits")
    seeds = scratch.keep(_seeds(grams.select("item", "key"), hits, SEED_SHARE, LEAST_SEEDS), "seeds")
    return scratch.keep(hits.join(_few(seeds, broadcast_rows), "key").select("text_key", "item").distinct(), "candidates"), seeds


def _aligned(least: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        numbers, out = _Numbers(), []
        texts = rows[rows["text"].notna()].drop_duplicates("text_key")
        pairs = rows[rows["text"].isna()].groupby("text_key", sort=False)
        for key, text in zip(texts["text_key"], texts["text"], strict=True):
            if key not in pairs.groups:
                continue
            one, mine = _Text(numbers.of(text)), pairs.get_group(key)
            for item, words, seeds in zip(mine["item"], mine["words"], mine["seeds"], strict=True):
                found = one.best(np.frombuffer(words, np.uint64), np.asarray(seeds, np.int64), least)
                if found:
                    out.append((key, int(item), *found))
        return pd.DataFrame(out, columns=["text_key", "item", "score", "start_word", "end_word"])

    return run


def copies(docs: DataFrame, items: DataFrame, scratch: Scratch, least: float = LEAST_SCORE, bits: int = MAP_BITS, pairs: int = PAIRS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """text_key, item, score, start_word, end_word: the best passage for each item that a text copies, once for equal texts.

    Groups of about ``pairs`` pairs are aligned together, with each of their
    texts once; a text with more pairs is dealt to several groups.
    """
    found, seeds = candidates(docs, items, scratch, bits, broadcast_rows)
    n = found.count()
    crowded = found.groupBy("text_key").agg(F.ceil(F.count(F.lit(1)) / pairs).alias("pieces")).filter("pieces > 1")
    piece = F.pmod(F.xxhash64("item"), F.coalesce("pieces", F.lit(1)))
    group = F.pmod(F.xxhash64("text_key", piece), F.lit(-(-n // pairs) or 1))
    dealt = scratch.keep(found.join(_few(scratch.keep(crowded, "crowded"), broadcast_rows), "text_key", "left").select("text_key", "item", group.alias("group")), "dealt")
    sought = items.join(seeds.groupBy("item").agg(F.collect_list("key").alias("seeds")), "item").select("item", "words", "seeds")
    sought = scratch.keep(sought, "sought")
    size = sought.agg(F.coalesce(F.sum(F.length("words") + 8 * F.size("seeds")), F.lit(0))).first()[0]
    each = dealt.join(F.broadcast(sought) if size <= BROADCAST_BYTES else sought, "item")
    texts = docs.select(_key(F.col("text")).alias("text_key"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["text_key"])
    texts = texts.join(_few(scratch.keep(dealt.select("text_key", "group").distinct(), "groups"), broadcast_rows), "text_key")
    rows = each.unionByName(texts, allowMissingColumns=True)
    schema = "text_key binary, item long, score double, start_word long, end_word long"
    return scratch.keep(rows.groupBy("group").applyInPandas(_aligned(least), schema), "copies")


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, bits: int = MAP_BITS, pairs: int = PAIRS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, score, start_word and end_word: the best passage for each item that a row of ``docs`` copies.

    A copy's score is at least ``least`` of the item's own and at least FLOOR,
    or all of it: of seven words two may be others, of six one, and up to four
    must stand as they are. Null and empty texts match nothing, nor do items
    without words. Items of equal text match alike; so do repeated rows, each
    with rows of its own. Of passages with equal scores the first counts.
    Other columns, whatever their names, are not read. An empty table on
    either side gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    texts, items = _numbered_items(benchmark, scratch)
    found = copies(docs, items, scratch, least, bits, pairs, broadcast_rows)
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").join(texts, "text").select("item_id", "item")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(F.col("text")).alias("text_key"))
    return rows.join(found, "text_key").join(named, "item").select("doc_id", "item_id", "score", "start_word", "end_word")


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, bits: int = MAP_BITS, pairs: int = PAIRS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that copy no item of ``benchmark``, with all their columns.

    Null and empty texts copy nothing and stay, as do all rows where there
    are no items; of repeated rows all stay or none. Copies are those of
    ``matches``.
    """
    scratch = Scratch(docs.sparkSession, "clean")
    found = copies(docs, _numbered_items(benchmark, scratch)[1], scratch, least, bits, pairs, broadcast_rows)
    copied = scratch.keep(found.select(F.col("text_key").alias("__text")).distinct(), "copied")
    return docs.join(_few(copied, broadcast_rows), _key(docs["text"]) == copied["__text"], "left_anti")
