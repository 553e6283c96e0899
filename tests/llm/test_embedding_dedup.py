"""Embedding near-duplicates against all cosines."""

from __future__ import annotations

import math

import numpy as np
import pytest

from sceneloom.llm import embedding_dedup as E

from .helpers import rows_of, scratch


def apart(rng, v: np.ndarray, cosine: float) -> np.ndarray:
    """A vector at a given cosine from ``v``."""
    e = rng.standard_normal(len(v))
    u = v / np.linalg.norm(v)
    e -= (e @ u) * u
    return cosine * u + math.sqrt(1 - cosine * cosine) * e / np.linalg.norm(e)


def table(spark, vectors, kind="double"):
    cast = lambda v: None if v is None else [None if x is None else float(x) for x in v]
    return spark.createDataFrame([(i, cast(v), k % 3, "x") for k, (i, v) in enumerate(vectors)], f"vec_id long, embedding array<{kind}>, label int, item string")


def all_links(vectors: list) -> list[set[int]]:
    """Links by place, from all cosines."""
    usable = [k for k, (_, v) in enumerate(vectors) if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max((len(vectors[k][1]) for k in usable), default=0)
    m = np.array([np.pad(np.asarray(vectors[k][1], float), (0, width - len(vectors[k][1]))) for k in usable]).reshape(len(usable), width)
    m /= np.linalg.norm(m, axis=1)[:, None]
    out = [set() for _ in vectors]
    for k, row in zip(usable, (m @ m.T) >= 0.9, strict=True):
        out[k] = {usable[j] for j in np.flatnonzero(row)} - {k}
    return out


def expected(vectors: list) -> list[tuple]:
    links, component = all_links(vectors), {}
    for k in range(len(vectors)):
        if k not in component:
            part, edge = {k}, {k}
            while edge:
                edge = {j for i in edge for j in links[i]} - part
                part |= edge
            least = min((vectors[j][0] for j in part if vectors[j][0] is not None), default=None)
            component |= dict.fromkeys(part, least)
    return [(i, len(links[k]), component[k], i == component[k]) for k, (i, _) in enumerate(vectors)]


def planted(rng, singles: int, groups: list[tuple[int, float]], dims: int = 64) -> list:
    vectors = list(rng.standard_normal((singles, dims)))
    for size, cosine in groups:
        v = rng.standard_normal(dims)
        vectors += [apart(rng, v, cosine) * rng.uniform(0.5, 2) for _ in range(size)]
    order = rng.permutation(len(vectors))
    return [(int(k), vectors[j]) for k, j in enumerate(order)]


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("limits", [{}, {"block": 32, "centres": 4}])
def test_near_copies_equal_all_cosines(spark, limits):
    """Groups of tight copies are whole, with lists in one block and in many."""
    rng = np.random.default_rng(5)
    vectors = planted(rng, 300, [(250, 0.993), (2, 0.99), (40, 0.995), (3, 0.97)])
    vectors += [(1000 + k, vectors[0][1]) for k in range(70)] + [(2000, vectors[5][1] * 3)]
    got = rows_of(E.near_duplicates(table(spark, vectors), scratch(spark), **limits))
    assert by_id(got) == by_id(expected(vectors))


def test_recall_of_pairs_near_the_threshold(spark):
    """Of planted pairs at cosines from 0.9 to 0.99 at least nine in ten are found at each; none below 0.9."""
    rng = np.random.default_rng(6)
    singles, cosines = rng.standard_normal((1500, 64)), (0.9001, 0.91, 0.93, 0.95, 0.99)
    vectors = [(k, v) for k, v in enumerate(singles)]
    for n, cosine in enumerate(cosines):
        vectors += [(10_000 * (n + 1) + k, apart(rng, singles[200 * n + k], cosine)) for k in range(200)]
    vectors += [(90_000 + k, apart(rng, singles[1200 + k], 0.899)) for k in range(200)]
    got = {r[0]: r for r in rows_of(E.near_duplicates(table(spark, vectors), scratch(spark)))}
    for n in range(len(cosines)):
        assert sum(got[10_000 * (n + 1) + k][2] == 200 * n + k for k in range(200)) >= 180
    want = {r[0]: r for r in expected(vectors)}
    assert all(got[i][1] <= want[i][1] for i in want) and all(got[90_000 + k][1] == want[90_000 + k][1] == 0 for k in range(200))


def test_candidates_share_pivots():
    rng = np.random.default_rng(1)
    for pivots in (8, 400):
        a, b = (np.array([rng.permutation(pivots)[:6] for _ in range(n)]) for n in (50, 70))
        want = {(i, j) for i in range(50) for j in range(70) if len(set(a[i]) & set(b[j])) >= 2}
        assert set(zip(*map(np.ndarray.tolist, E.candidates(a, b, 2)), strict=True)) == want


def test_pivots_are_no_copies_and_bounded(spark):
    rng = np.random.default_rng(2)
    vectors = planted(rng, 100, [(300, 0.99)])
    items = table(spark, vectors).selectExpr("vec_id AS item", "embedding AS vec")
    pivots = E.choose_pivots(items, 400)
    assert len(pivots) <= 40 and (np.triu(pivots @ pivots.T, 1) < E.MOST_ALIKE).all()


def test_odd_rows_have_a_result(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 2.0]), (8, [2.0, 4.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 0.0]), (10, [-1.0, -2.0]), (None, [5.0, -9.0, 3.0]), (11, [1e150, 2e150]), (12, [-0.0, 0.0])]
    got = rows_of(E.near_duplicates(table(spark, vectors), scratch(spark)))
    assert by_id(got) == by_id(expected(vectors))
    empty = table(spark, vectors).limit(0)
    assert E.near_duplicates(empty, scratch(spark)).collect() == []
    assert by_id(rows_of(E.near_duplicates(table(spark, vectors[:4], "float"), scratch(spark)))) == by_id(expected(vectors[:4]))
