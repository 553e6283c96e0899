"""Periodic runs: stretches of words that repeat with a period, by a suffix automaton.

Each state of a text's automaton stands for the word sequences that end at the
same positions. Along the suffix links these sets of end positions are merged
from the longest state down, the smaller into the larger one. Two positions
that become neighbours at a state share as many words before them as the state
is long; where they stand no farther apart than that, the words between them
stand twice in a row. Such squares are extended to runs.

Only stretches whose words all stand in word groups that come again can hold
a run that is long enough, so the automaton is built for these alone.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

#: Least words of a run, and how often its period fits in at least.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Positions in a piece of an ordered set.
PIECE = 1024


class Ends:
    """An ordered set of end positions, in pieces, so that no insertion moves more than one of them."""

    __slots__ = ("pieces", "heads", "size")

    def __init__(self, at: int | None = None):
        self.pieces = [] if at is None else [[at]]
        self.heads = [] if at is None else [at]
        self.size = len(self.heads)

    def __iter__(self) -> Iterator[int]:
        for piece in self.pieces:
            yield from piece

    def insert(self, at: int) -> tuple[int | None, int | None]:
        """Add a position that isn't there; gives its neighbours."""
        if not self.pieces:
            self.pieces, self.heads, self.size = [[at]], [at], 1
            return None, None
        k = max(bisect_left(self.heads, at) - 1, 0)
        piece = self.pieces[k]
        j = bisect_left(piece, at)
        before = piece[j - 1] if j else None
        after = piece[j] if j < len(piece) else self.heads[k + 1] if k + 1 < len(self.heads) else None
        piece.insert(j, at)
        self.size += 1
        if not j:
            self.heads[k] = at
        if len(piece) > PIECE:
            half = PIECE // 2
            self.pieces.insert(k + 1, piece[half:])
            self.heads.insert(k + 1, piece[half])
            del piece[half:]
        return before, after


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and end position (-1 for clones and the root) of each state."""
    length, link, end, steps, last = [0], [-1], [-1], [{}], 0
    for at, word in enumerate(words):
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        end.append(at)
        steps.append({})
        p = last
        while p >= 0 and word not in steps[p]:
            steps[p][word] = new
            p = link[p]
        if p >= 0:
            q = steps[p][word]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                steps.append(dict(steps[q]))
                while p >= 0 and steps[p].get(word) == q:
                    steps[p][word] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return length, link, end


def squares(words: list[int]) -> dict[tuple[int, int], int]:
    """The last position of the longest known stretch for each (distance, first position) at which words stand twice in a row."""
    length, link, end = automaton(words)
    sets: list[Ends | None] = [Ends(at) if at >= 0 else Ends() for at in end]
    found: dict[tuple[int, int], int] = {}
    for state in np.argsort(-np.array(length), kind="stable").tolist():
        parent = link[state]
        if parent <= 0:  # at the root no two words are shared
            sets[state] = None
            continue
        small, large, shared = sets[state], sets[parent], length[parent]
        if small.size > large.size:
            small, large = large, small
        for at in small:
            before, after = large.insert(at)
            if before is not None and at - before <= shared and found.get(key := (at - before, before - shared + 1), -1) < at:
                found[key] = at
            if after is not None and after - at <= shared and found.get(key := (after - at, at - shared + 1), -1) < after:
                found[key] = after
        sets[parent], sets[state] = large, None
    return found


def _prime_factors(n: int) -> list[int]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return out + [n] * (n > 1)


def runs_in(ids: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one stretch of word numbers, by start and period."""
    words, n, out = ids.tolist(), len(ids), set()
    for (period, first), last in squares(words).items():
        while first > 0 and words[first - 1] == words[first - 1 + period]:
            first -= 1
        while last + 1 < n and words[last + 1] == words[last + 1 - period]:
            last += 1
        size = last - first + 1
        if size < max(least, times * period) or (first, size, period) in out:
            continue
        # A shorter period would divide this one.
        if not any((ids[first : first + period] == ids[first + period // f : first + period + period // f]).all() for f in _prime_factors(period)):
            out.add((first, size, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[tuple[int, int]]:
    """(from, to) of the parts of a text that can hold a run.

    In a run of n words and period q each group of n - 2q words in a row
    stands again, q words before or after, and n - 2q is ``least * (1 - 2 /
    times)`` at least, as n is ``least`` and ``times * q`` or more.
    """
    group = least * (times - 2) // times
    n = len(ids) - group + 1
    if len(ids) < least or group < 1:
        return [(0, len(ids))] if len(ids) >= least else []
    hashed = np.zeros(n, np.uint64)
    for k in range(group):
        hashed = (hashed ^ ids[k : n + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
    order = np.argsort(hashed, kind="stable")
    same = hashed[order[1:]] == hashed[order[:-1]]
    again = np.zeros(n, np.int8)
    again[order[1:][same]] = again[order[:-1][same]] = 1
    turns = np.flatnonzero(np.diff(again, prepend=0, append=0))
    return [(a, b + group - 1) for a, b in turns.reshape(-1, 2).tolist() if b + group - 1 - a >= least]


def _examined(text: str | None, least: int, times: int) -> tuple[int, list[tuple[int, int, int]], str]:
    """Number of words, runs, and the text without the words that repeat in them."""
    # Of bytes, split() takes exactly the six breaks.
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if len(words) < least:
        return len(words), [], b" ".join(words).decode("utf-8", "surrogatepass")
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    runs = [(a + s, n, q) for a, b in stretches(ids, least, times) for s, n, q in runs_in(ids[a:b], least, times)]
    if runs:
        step = np.zeros(len(words) + 1, np.int64)
        for s, n, q in runs:
            step[s + q] += 1
            step[s + n] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0)]
    return len(ids), runs, b" ".join(words).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """doc_id, n_words, ``runs`` (array of start, length, period, by start and period) and ``collapsed`` for each row of ``docs`` (doc_id, text).

    A run is a stretch of words whose smallest period q fits in ``times``
    times or more, of ``least`` words or more, that no neighbouring word
    extends. ``collapsed`` has one space between the words that stand in no
    run after its first q words. Each text is worked on whole, in the task
    that reads it; nothing is shuffled. Null and empty texts have no words, no
    runs and an empty ``collapsed``; a null doc_id stays null; repeated rows
    give repeated rows; other columns are not read, whatever their names. An
    empty table gives no rows. Memory grows with the longest stretch that can
    hold a run, some 500 bytes a word.
    """
    if times < 2:
        raise ValueError("what stands less than twice in a row has no period")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [_examined(t if isinstance(t, str) else None, least, times) for t in rows["text"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "n_words": [f[0] for f in found], "runs": [[{"start": s, "length": n, "period": q} for s, n, q in f[1]] for f in found], "collapsed": [f[2] for f in found]})

    longs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return longs.mapInPandas(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_loops(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, with a loop of its own words from some word on in one text of ten, as hashes of doc_id say."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, words = F.floor(h / 10), words_of(F.col("text"))
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    looped = F.concat(F.slice(words, 1, a), F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))))
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), F.array_join(F.slice(looped, 1, n), " ")).otherwise(F.col("text")).alias("text"))


def _greater(a: Column, b: Column) -> Column:
    """Order of array_sort: greatest length / period first, then by start and period; ratios are compared exactly."""
    x, y = a["length"] * b["period"], b["length"] * a["period"]
    return F.when(x > y, -1).when(x < y, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of ``periodic_runs``' rows."""
    best = F.get(F.array_sort("runs", _greater), F.lit(0))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(told.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
