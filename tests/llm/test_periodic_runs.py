"""Periodic runs against a plain scan of all periods, word by word."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from sceneloom.llm import periodic_runs as R

from .helpers import rows_of


def plain_runs(words: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """All runs by trying each period at each place; the smallest period by trying all that are smaller."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                part = words[i : j + q]
                if not any(all(part[k] == part[k + p] for k in range(len(part) - p)) for p in range(1, q)):
                    out.append((i, j - i + q, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id: int | None, text: str | None) -> tuple:
    """The contract, read once more from its words."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    told, kept = "".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(w for k, w in enumerate(words) if k not in gone)
    from fractions import Fraction

    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(told), sha(kept)


def with_planted(rng: random.Random, size: int, letters: int) -> list[int]:
    words: list[int] = []
    while len(words) < size:
        if rng.random() < 0.4:
            unit = [rng.randrange(letters) for _ in range(rng.randint(1, 14))]
            words += (unit * 12)[: rng.randint(5, 12 * len(unit))]
        else:
            words += [rng.randrange(letters) for _ in range(rng.randint(1, 10))]
    return words


@pytest.mark.parametrize("letters", [1, 2, 3, 6, 40])
def test_runs_equal_a_plain_scan(letters):
    rng, seen = random.Random(letters), 0
    for _ in range(60):
        words = with_planted(rng, rng.randint(0, 160), letters)
        want = plain_runs(words)
        ids = np.array(words, np.int64)
        assert [(a + s, n, q) for a, b in R.stretches(ids) for s, n, q in R.runs_in(ids[a:b])] == want
        assert R.runs_in(ids) == want
        seen += len(want)
    assert seen > 30


def test_other_limits_equal_a_plain_scan():
    rng = random.Random(5)
    for least, times in ((2, 2), (6, 2), (9, 3), (12, 4)):
        for _ in range(40):
            words = with_planted(rng, 60, 3)
            ids = np.array(words, np.int64)
            assert [(a + s, n, q) for a, b in R.stretches(ids, least, times) for s, n, q in R.runs_in(ids[a:b], least, times)] == plain_runs(words, least, times)


def test_sets_of_ends_in_pieces_keep_order(monkeypatch):
    monkeypatch.setattr(R, "PIECE", 4)
    rng, ends, seen = random.Random(2), R.Ends(), []
    for at in rng.sample(range(1000), 300):
        before, after = ends.insert(at)
        assert before == max((x for x in seen if x < at), default=None) and after == min((x for x in seen if x > at), default=None)
        seen.append(at)
    assert list(ends) == sorted(seen) and ends.size == 300


def test_query_equals_the_contract(spark):
    rng = random.Random(9)
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    texts = [" ".join(f"w{rng.randrange(v)}" for _ in range(rng.randint(1, 150))) for v in (3, 30, 1000) for _ in range(20)]
    rows = [(i, t) for i, t in zip([*ids, *range(10_000, 10_020)], texts, strict=True)]
    rows += [(7, None), (8, ""), (9, " \t\n"), (None, "a b " * 20), (None, None), (11, "x\x1cy " * 30), (12, "a  b c\t" * 30), (12, "a  b c\t" * 30), (13, "w " * 23), (14, "w " * 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(R.digests(R.periodic_runs(R.with_loops(docs))).drop("n_words"))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted((plain_row(*r) for r in rows), key=key)


def test_real_outputs_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "intro " + "a b c " * 9 + "end", 5, 6, "x")], "doc_id int, text string, runs int, start int, collapsed string")
    row = R.periodic_runs(docs).first()
    assert [tuple(r) for r in row.runs] == [(1, 27, 3)] and row.collapsed == "intro a b c end" and row.n_words == 29
    assert R.periodic_runs(docs.limit(0)).collect() == []


def test_very_long_texts_are_whole():
    rng = random.Random(4)
    odd = [rng.randrange(50_000) for _ in range(40_000)]
    for words in ([0] * 60_000, [k % 7 for k in range(60_000)], odd + odd + odd, odd):
        text, began = " ".join(f"w{k}" for k in words), time.perf_counter()
        n, runs, kept = R._examined(text, 24, 3)
        assert n == len(words) and time.perf_counter() - began < 60
        assert runs == {60_000: [(0, 60_000, 1 if words[1] == 0 else 7)], 120_000: [(0, 120_000, 40_000)]}.get(n, [])
        assert len(kept.split()) == {60_000: 1 if words[1] == 0 else 7}.get(n, 40_000)
