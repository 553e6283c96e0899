import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sceneloom.llm import lm_scoring as lm

from .helpers import documents, scratch


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def brute(texts, order, weights):
    """Scores from plain counters, with given mixture weights."""
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    padded = lambda t, k: [b"<s>"] * (k - 1) + tokens(t)
    grams = {k: Counter(tuple(p[i : i + k]) for t, h in zip(texts, held, strict=True) if not h for p in [padded(t, k)] for i in range(len(p) - k + 1)) for k in range(1, order + 1)}
    context = {k: Counter() for k in range(2, order + 1)}
    for k in context:
        for g, c in grams[k].items():
            context[k][g[:-1]] += c
    n, v = sum(grams[1].values()), len(grams[1])
    out = []
    for i, t in enumerate(texts):
        base = score = 0.0
        known = 0
        for j in range(len(tokens(t))):
            g = {k: tuple(padded(t, k)[j : j + k]) for k in grams}
            c = grams[1][g[1]]
            known += c > 0
            base += math.log10((c + 1) / (n + v + 1))
            p = [1 / (v + 1), c / max(n, 1)] + [grams[k][g[k]] / max(context[k][g[k][:-1]], 1) for k in context]
            seen = context[order][g[order][:-1]] if order > 1 else 0
            score += math.log10(sum(w * x for w, x in zip(weights[seen.bit_length()], p, strict=True)))
        out.append((i, held[i], len(tokens(t)), known, n, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_plain_counters(spark, monkeypatch, order):
    rng = random.Random(order)
    words = [f"W{i}" for i in range(30)] + ["né", "the", "THE"]
    texts = [" ".join(rng.choice(words[: rng.choice([3, 33])]) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    texts += [None, "", " \t\n", "the the the", "the the the"]
    seen = {}
    real = lm.weight_table
    monkeypatch.setattr(lm, "weight_table", lambda learned, k: seen.setdefault("w", real(learned, k)))
    rows = lm.score_documents(documents(spark, texts).repartition(3), scratch(spark), order=order, chunk_tokens=300, bucket_keys=200).collect()
    want = brute(texts, order, seen["w"])
    for got, exp in zip(sorted(rows), want, strict=True):
        assert tuple(got)[:5] == exp[:5]
        assert tuple(got)[5:] == pytest.approx(exp[5:], rel=1e-9)
    assert np.allclose(seen["w"].sum(1), 1)
    assert np.allclose(seen["w"], plain_weights(texts, order), atol=1e-3)


def plain_weights(texts, order):
    """Expectation-maximisation token by token, on probabilities rounded to an eighth of a power of two, with the text's own counts deleted."""
    fold = [zlib.crc32(str(i).encode()) % 7 for i in range(len(texts))]
    padded = lambda t, k: [b"<s>"] * (k - 1) + tokens(t)
    own = [{k: Counter(tuple(p[i : i + k]) for p in [padded(t, k)] for i in range(len(p) - k + 1)) for k in range(1, order + 1)} for t in texts]
    grams = {k: sum((o[k] for o, f in zip(own, fold, strict=True) if f != 2), Counter()) for k in range(1, order + 1)}
    n, v, cells = sum(grams[1].values()), len(grams[1]), {}
    for i, t in enumerate(texts):
        if fold[i] != 3:
            continue
        left = {k: grams[k] - own[i][k] for k in grams}
        context = {k: Counter() for k in grams}
        for k in grams:
            for g, c in left[k].items():
                context[k][g[:-1]] += c
        for j in range(len(tokens(t))):
            g = {k: tuple(padded(t, k)[j : j + k]) for k in grams}
            p = [1 / (v + 1), left[1][g[1]] / max(n - len(tokens(t)), 1)] + [left[k][g[k]] / max(context[k][g[k][:-1]], 1) for k in range(2, order + 1)]
            p = [p[0]] + [2.0 ** (-round(-math.log2(x) * 8) / 8) if x else 0.0 for x in p[1:]]
            seen = context[order][g[order][:-1]] if order > 1 else 0
            cells.setdefault(seen.bit_length(), []).append(p)
    cells[-1] = [p for ps in cells.values() for p in ps]
    learned = []
    for level, ps in cells.items():
        p, w = np.array(ps), np.full(order + 1, 1 / (order + 1))
        for _ in range(lm.ROUNDS):
            share = p * w
            w = (share / share.sum(1, keepdims=True)).mean(0)
        learned.append({"level": level, "weights": w})
    return WEIGHTS(learned, order)


WEIGHTS = lm.weight_table


def test_held_out_rows_change_no_other_score(spark):
    texts = ["a b c d " * (i % 7 + 1) + f"x{i % 11}" for i in range(60)]
    out = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    other = ["z z z" if i == out[0] else t for i, t in enumerate(texts)]
    one, two = ({r.doc_id: r.score for r in lm.score_documents(documents(spark, t), scratch(spark)).collect()} for t in (texts, other))
    assert all(one[i] == two[i] for i in one if i != out[0]) and one[out[0]] != two[out[0]]


def test_weights_help_held_out_text(spark):
    rng = random.Random(9)
    follow = {f"w{i}": [f"w{rng.randrange(200)}" for _ in range(3)] for i in range(200)}

    def walk():
        w, out = "w0", []
        for _ in range(60):
            out.append(w)
            w = rng.choice(follow[w])
        return " ".join(out)

    rows = lm.score_documents(documents(spark, [walk() for _ in range(300)]), scratch(spark)).filter("held_out").collect()
    assert rows
    assert sum(r.score for r in rows) > 0.7 * sum(r.base_score for r in rows)


def test_no_training_rows_null_ids_and_empty_table(spark):
    only = documents(spark, ["a b", None]).selectExpr("cast(null as long) as doc_id", "text")
    rows = lm.score_documents(only, scratch(spark)).collect()
    assert [r.held_out for r in rows] == [False, False] and sorted(r.n_tokens for r in rows) == [1, 3]
    from pyspark.sql import functions as F

    rows = lm.score_documents(only, scratch(spark), held=lambda d: F.lit(True)).collect()
    assert {r.n_known for r in rows} == {0} and {r.base_score for r in rows} == {0.0}
    assert lm.score_documents(documents(spark, []), scratch(spark)).collect() == []
