"""SimHash near-duplicates, linked by multi-index hashing.

A 64-bit fingerprint is cut in two 32-bit segments. Two fingerprints at 3 or
fewer differing bits differ by at most 1 bit in one of them, so each looks up
the ball of radius 1 around each of its segments. Of two values one bit
apart the smaller one reaches the larger by setting a bit; so a ball needs
only the bits that are not set, and each pair is fetched once.

Copies of a given similarity differ in a share of the bits, not in 3. For
them (``one_of_each``) a fingerprint takes several words, whose many short
segments meet in a ball of radius 1 with a known chance, and complete
distances over all words decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, with_row_ids
from .components import components

MAX_BITS = 3
WIDTH = 3
#: Near copies: shingles of so many words, and the least Jaccard similarity of their sets.
COPY_WIDTH, COPY_SIMILARITY = 5, 0.8
#: Words of 64 bits in a near copy's fingerprint, and bits of a segment: 8 words have 24 segments of 21 bits.
COPY_WORDS, COPY_CUT = 8, 21
#: Table entries under one key that are compared row by row; keys with more go in blocks.
FEW = 32
#: The same for near copies: a crowded key's complete fingerprints are compared, so that fewer pairs come about that aren't near.
COPY_FEW = 16
#: Fingerprints in a block of a crowded key.
BLOCK = 1024
#: Fingerprints with a common segment that meet for the first links.
BUCKET = 8
#: Crowded keys that may be broadcast to the lookups; beyond, the join shuffles.
BROADCAST_KEYS = 100_000
_HASHES_AT_ONCE = 1 << 16


def _shingle_hashes(text: str | None, width: int) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = (b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in joined), np.uint64)


def _majority(hashes: np.ndarray) -> np.uint64:
    """Bit i is 1 if it is set in over half of the hashes; 0 without any."""
    set_bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _HASHES_AT_ONCE):
        octets = hashes[k : k + _HASHES_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0]


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 (seed 42) of the text's word shingles; 0 without words."""
    return int(_majority(_shingle_hashes(text, width)))


def _hashed_again(hashes: np.ndarray, words: int) -> np.ndarray:
    """A row of hashes for each word, the first as they are."""
    x = hashes[None] + (np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x[0] = hashes
    return x


def wide_fingerprint(text: str | None, width: int = COPY_WIDTH, words: int = COPY_WORDS) -> np.ndarray:
    """``words`` fingerprints of one text: the first by the shingles' hashes, the others by these hashed again."""
    hashes, set_bits, lanes = _shingle_hashes(text, width), np.zeros((words, 8, 8), np.int64), np.uint64(0x0101010101010101)
    for k in range(0, len(hashes), _HASHES_AT_ONCE):
        x = _hashed_again(hashes[k : k + _HASHES_AT_ONCE], words)
        # A byte counts to 255: so many hashes are summed at a time, eight bits of each together.
        cuts = np.arange(0, x.shape[1], 255)
        for b in range(8):
            sums = np.add.reduceat((x >> np.uint64(b)) & lanes, cuts, axis=1).astype("<u8")
            set_bits[:, :, b] += sums.view(np.uint8).reshape(words, -1, 8).sum(1, dtype=np.int64)
    return np.packbits((2 * set_bits > len(hashes)).reshape(words, 64), axis=1, bitorder="little").view("<u8").ravel()


def most_bits(similarity: float, bits: int, deviations: float) -> int:
    """Of ``bits`` those that sets of shingles of equal size and a Jaccard similarity differ in at most, but for so many standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def fingerprints(docs: DataFrame, width: int = WIDTH, carry: list[str] | None = None, words: int = 0) -> DataFrame:
    """doc_id, the long columns ``carry``, and ``fp``: the fingerprint of ``text`` as a signed long; with ``words``, ``wide``: all of them."""
    kept = ["doc_id", *(carry or [])]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [t if isinstance(t, str) else None for t in rows["text"]]
            if words:
                wide = [wide_fingerprint(t, width, words).view(np.int64) for t in texts]
                yield rows[kept].assign(fp=np.array([w[0] for w in wide], np.int64), wide=wide)
            else:
                values = np.array([fingerprint(t, width) for t in texts], np.uint64)
                yield rows[kept].assign(fp=values.view(np.int64))

    longs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(carry or []), "text")
    return longs.mapInPandas(add, ", ".join(f"{c} long" for c in [*kept, "fp"]) + (", wide array<long>" if words else ""))


def _keys(fps: DataFrame, words: list[Column], cut: int) -> tuple[DataFrame, DataFrame]:
    """(fp, key) of the table, and of the lookups one set bit away, with ``root`` if there is one. A key is the segment's number and value."""
    own = [c for c in ("fp", "root") if c in fps.columns]
    mask = F.lit((1 << cut) - 1).cast("long")
    values = [F.shiftrightunsigned(w, cut * j).bitwiseAND(mask) for w in words for j in range(64 // cut)]
    table = fps.select(*own, F.explode(F.array(*[v + F.lit(k << cut).cast("long") for k, v in enumerate(values)])).alias("key"))
    masks = F.array(*[F.lit(1 << b).cast("long") for b in range(cut)])
    unset = F.filter(masks, lambda m: F.col("key").bitwiseAND(m) == 0)
    lookups = table.select(*own, F.explode(F.transform(unset, lambda m: F.col("key") + m)).alias("key"))
    return table, lookups


def _trees(rows: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Edges that join what can reach another within one pair of blocks: a tree for each part, not all pairs; between ``root`` if there is one."""
    rows = rows.drop_duplicates("fp").sort_values("fp")
    fps = rows["fp"].to_numpy(np.int64)
    wide = np.stack(rows["wide"].to_list()).astype(np.int64) if "wide" in rows else fps[:, None]
    apart = np.zeros((len(fps), len(fps)), np.int16)
    for word in wide.view(np.uint64).T:
        apart += np.bitwise_count(word[:, None] ^ word[None, :])
    near = apart <= bits
    roots = rows["root"].to_numpy(np.int64) if "root" in rows else fps
    left, out = np.ones(len(fps), bool), []
    for i in range(len(fps)):
        if not left[i]:
            continue
        left[i] = False
        edge = np.array([i])
        while len(edge):
            edge = np.flatnonzero(near[edge].any(0) & left)
            left[edge] = False
            out += [(roots[j], roots[i]) for j in edge if roots[j] != roots[i]]
    return pd.DataFrame(sorted(set(out)), columns=["a", "b"]).astype("int64")


def _fetched(table: DataFrame, lookups: DataFrame, scratch: Scratch, near: Callable[[Column, Column], Column], few: int, block: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b) that meet under a key with up to ``few`` table entries and are ``near``; and crowded keys' rows, dealt (key, i, j, fp) for pairs of blocks.

    Rows of one ``root``, if they have such a column, are joined already and
    don't meet. A crowded key is dealt into blocks of table entries and
    lookups alike; each pair of blocks is one group.
    """
    crowded = scratch.keep(table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > few).select("key"), "crowded")
    n = crowded.count()
    those = F.broadcast(crowded) if n <= BROADCAST_KEYS else crowded
    rows = table.withColumn("own", F.lit(True)).unionByName(lookups.withColumn("own", F.lit(False)))
    entries = (table.join(those, "key", "left_anti") if n else table).select("key", F.col("fp").alias("other"), *([F.col("root").alias("its")] if "root" in table.columns else []))
    apart = F.col("root") != F.col("its") if "root" in table.columns else F.lit(True)
    pairs = rows.join(entries, "key").filter(apart & near(F.col("fp"), F.col("other")) & ((F.col("fp") > F.col("other")) | ~F.col("own"))).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    if not n:
        return pairs, None
    rows = scratch.keep(rows.join(those, "key", "left_semi").select("key", "fp"), "crowded_rows")
    counts = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int")
    dealt = rows.join(counts, "key").select("key", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("its"))
    return pairs, dealt.select("key", "fp", F.least("mine", "its").alias("i"), F.greatest("mine", "its").alias("j"))


def links(fps: DataFrame, scratch: Scratch, bits: int = MAX_BITS, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) over distinct ``fp`` that have the components of all pairs at ``bits`` (at most 3) or fewer bits.

    Under a key with up to ``few`` table entries each row meets them all; a
    crowded key's pairs of blocks give the edges of their trees only.
    """
    if not 0 <= bits <= 3:
        raise ValueError("two segments and balls of radius 1 find all pairs at 3 bits or fewer only")
    table, lookups = _keys(fps, [F.col("fp")], 32)
    pairs, dealt = _fetched(table, lookups, scratch, lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= bits, few, block)
    if dealt is None:
        return pairs
    return pairs.unionByName(dealt.groupBy("key", "i", "j").applyInPandas(lambda rows: _trees(rows, bits), "a long, b long"))


def _apart(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def first_links(fps: DataFrame, most: int, at_hand: int, words: int = COPY_WORDS, cut: int = COPY_CUT, bucket: int = BUCKET) -> DataFrame:
    """Some of the links (a, b), a few for each fingerprint, that already join most of a large group.

    Those that share the first segment of a word are dealt into buckets of
    about ``bucket``, and only these meet, however many share it.
    """
    mask = F.lit((1 << cut) - 1).cast("long")
    firsts = [F.get("wide", F.lit(k)).bitwiseAND(mask) + F.lit(k << cut).cast("long") for k in range(words)]
    table = fps.select("fp", F.explode(F.array(*firsts)).alias("key"))
    buckets = table.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / bucket).alias("n"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    dealt = table.join(buckets, "key").select("fp", "key", F.pmod(F.xxhash64("fp", "key"), F.col("n")).alias("part"))
    other = dealt.select(F.col("fp").alias("b"), "key", "part")
    met = dealt.join(other, ["key", "part"]).filter((F.col("fp") > F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= at_hand))
    side = lambda c: fps.select(F.col("fp").alias(c), F.col("wide").alias(f"wide_{c}"))
    pairs = met.select(F.col("fp").alias("a"), "b").distinct().join(side("a"), "a").join(side("b"), "b")
    return pairs.filter(_apart("wide_a", "wide_b") <= most).select("a", "b")


def copy_groups(fps: DataFrame, scratch: Scratch, similarity: float = COPY_SIMILARITY, words: int = COPY_WORDS, cut: int = COPY_CUT, few: int = COPY_FEW, block: int = BLOCK) -> DataFrame:
    """(fp, root) for each distinct ``fp`` (fp, wide): the least one that is reached by links of complete fingerprints that differ in the bits of ``similarity``, or few more.

    Two standard deviations above the bits expected at that similarity count
    as near. First links join most of a large group, by few for each member.
    Then pairs that share a segment's ball and aren't joined yet are
    held against the one word at hand, and those that pass against all; what
    links groups is told once for each pair of groups.
    """
    most, at_hand = most_bits(similarity, 64 * words, 2), most_bits(similarity, 64, 2.5)
    first = components(first_links(fps, most, at_hand, words, cut), scratch).withColumnRenamed("node", "fp")
    fps = scratch.keep(fps.join(first, "fp", "left").select("fp", "wide", F.coalesce("root", "fp").alias("root")), "first")
    table, lookups = _keys(fps, [F.get("wide", F.lit(k)) for k in range(words)], cut)
    pairs, dealt = _fetched(table, lookups, scratch, lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= at_hand, few, block)
    side = lambda c: fps.select(F.col("fp").alias(c), F.col("wide").alias(f"wide_{c}"), F.col("root").alias(f"root_{c}"))
    met = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    near = met.filter(_apart("wide_a", "wide_b") <= most).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    if dealt is not None:
        dealt = dealt.join(fps, "fp")
        near = near.unionByName(dealt.groupBy("key", "i", "j").applyInPandas(lambda rows: _trees(rows, most), "a long, b long"))
    roots = components(near, Scratch(scratch.spark, "groups")).select(F.col("node").alias("root"), F.col("root").alias("last"))
    return fps.join(roots, "root", "left").select("fp", F.coalesce("last", "root").alias("root"))


def near_duplicates(docs: DataFrame, scratch: Scratch, width: int = WIDTH, bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp and component_id for each row of ``docs``; the least doc_id that is reachable by links.

    Null and empty texts have fingerprint 0 and link like any other. Rows
    that repeat, and equal texts, share a fingerprint and so a component. A
    null doc_id is never the least; a component of nulls only has a null id.
    An empty table gives no rows.
    """
    rows = scratch.keep(fingerprints(docs, width), "fingerprints")
    return rows.join(component_ids(rows, scratch, bits), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, scratch: Scratch, width: int = COPY_WIDTH, similarity: float = COPY_SIMILARITY, words: int = COPY_WORDS, cut: int = COPY_CUT) -> DataFrame:
    """One row of each group of near copies, with all its columns: the one of the least doc_id (null last), of repeated rows any one.

    Near are texts whose sets of ``width``-word shingles have about
    ``similarity`` or more, by the differing bits of wide fingerprints; texts
    of equal first words of these are one. Texts without words are alike.
    """
    rows = with_row_ids(docs, scratch)
    marked = scratch.keep(fingerprints(rows, width, ["__rid"], words), "fingerprints")
    fps = scratch.keep(marked.groupBy("fp").agg(F.min("wide").alias("wide")), "wide")
    roots = scratch.keep(copy_groups(fps, scratch, similarity, words, cut), "roots")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__rid"))["__rid"]
    kept = marked.select("fp", "doc_id", "__rid").join(roots, "fp").groupBy("root").agg(first.alias("__rid")).select("__rid")
    return rows.join(kept, "__rid", "left_semi").select(docs.columns)


def component_ids(rows: DataFrame, scratch: Scratch, bits: int = MAX_BITS) -> DataFrame:
    """(fp, component_id) for each distinct fp of ``rows`` (doc_id, fp)."""
    fps = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(fps.select("fp"), scratch, bits), scratch)
    known = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    known = scratch.keep(known, "roots")
    return known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
