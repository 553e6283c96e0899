import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sceneloom.llm import suffix_dedup as sd
from sceneloom.llm.suffix_dedup import found_again, remove_repeats

from .helpers import documents, scratch


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for k, d in enumerate(data):
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((k, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def made(rng, alphabet, n):
    parts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 60))) for _ in range(12)]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.5 else "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 9))) for _ in range(n)]
    return texts + texts[:3] + [None, "", "é" * 80, "ab" * 70, "abab" * 30]


@pytest.mark.parametrize(("alphabet", "hot"), [("ab", 20_000), ("abcdefgh ñ", 20_000), ("abcdefgh", 1), ("ab", 2)])
def test_equals_brute_force(spark, alphabet, hot):
    texts = made(random.Random(len(alphabet) + hot), alphabet, 60)
    docs = documents(spark, texts).repartition(3)
    rows = remove_repeats(docs, scratch(spark), length=40, gram=16, hot=hot).collect()
    assert sorted(map(tuple, rows)) == sorted(brute(texts, 40))


@pytest.mark.parametrize("hot", [sd.HOT, 6])
def test_production_length_and_ties(spark, hot):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, edge = say(60), say(70)[:200]
    texts = [say(80) + passage + say(50) for _ in range(9)] + [say(40) + edge + say(3), edge, edge[:199], say(300), passage * 4, passage * 4]
    texts += [say(30) + passage[k:] + say(30) for k in range(12)] + [passage[: 150 + 20 * k] for k in range(9)]
    rows = remove_repeats(documents(spark, texts), scratch(spark), hot=hot).collect()
    assert sorted(map(tuple, rows)) == sorted(brute(texts, 200))


def test_empty_table(spark):
    assert remove_repeats(documents(spark, []), scratch(spark)).collect() == []


def test_one_context_has_no_other():
    low, high = found_again([b"x" * 20], np.array([1]), np.array([5]), length=12, gram=6)
    assert high.tolist() == [-1]


def test_multikey_quicksort_equals_a_plain_sort():
    rng = np.random.default_rng(8)
    for n, width, values in ((0, 3, 5), (1, 3, 5), (200, 1, 4), (500, 4, 2), (3000, 6, 3), (3000, 3, 1 << 40), (400, 5, 1)):
        words = rng.integers(0, values, (n, width)).astype(np.uint64)
        order = sd.multikey_order(words)
        assert [tuple(w) for w in words[order]] == sorted(map(tuple, words)) and (order == np.lexsort(words.T[::-1])).all()
    assert (sd.multikey_order(np.arange(5000, dtype=np.uint64)[::-1, None]) == np.arange(5000)[::-1]).all()
