import math
import zlib
from itertools import product

import pytest
import xxhash
from pyspark.sql import functions as F

from sceneloom.llm import sharding as sd

from .helpers import documents, scratch


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (3, 3)])
def test_curve_visits_each_cell_by_single_steps(spark, dims, bits):
    cells = spark.createDataFrame(list(product(range(1 << bits), repeat=dims)), ", ".join(f"x{i} int" for i in range(dims)))
    rows = cells.withColumn("h", sd.hilbert_index([F.col(f"x{i}") for i in range(dims)], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << bits * dims))
    assert all(sum(abs(x - y) for x, y in zip(a[:-1], b[:-1], strict=True)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_law_slots_groups_and_reruns(spark):
    texts = [f"text {i % 37} " * (i % 50) for i in range(500)] + ["hot"] * 300 + [None, "", "é"]
    docs = documents(spark, texts, sources=[None if i % 11 == 0 else f"src{i % 7}" for i in range(803)], langs=["en" if i % 3 else None for i in range(803)])
    rows = sd.hilbert_shards(docs.repartition(5), scratch(spark)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(803))
    per = [sorted(r.slot for r in rows if r.shard == s) for s in range(40)]
    assert all(p == list(range(len(p))) for p in per) and {len(p) for p in per} <= {20, 21}
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "rows", None)
    # Equal texts stand together: only a cut may part them.
    place = sorted(((r.shard, r.slot), texts[r.doc_id] or "") for r in rows)
    runs = sum(a[1] != b[1] for a, b in zip(place, place[1:], strict=False)) + 1
    assert runs == len({t or "" for t in texts})
    again = sd.hilbert_shards(docs.repartition(2), scratch(spark)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows), key=str)


def test_runs_prune_every_dimension(spark):
    docs = documents(spark, ["x" * (i % 97) + str(i) for i in range(2000)], sources=[f"s{i % 16:02d}" for i in range(2000)], langs=["l"] * 2000)
    rows = sd.hilbert_shards(docs, scratch(spark), shards=16).collect()
    spans = [len({r.doc_id % 16 for r in rows if r.shard == s}) for s in range(16)]
    assert sum(spans) / 16 < 9  # of 16, in files not cut by this column alone


def test_few_repeated_and_no_rows(spark):
    one = documents(spark, ["a", "a"]).withColumn("doc_id", F.lit(1).cast("long"))
    assert sorted((r.shard, r.slot) for r in sd.hilbert_shards(one, scratch(spark)).collect()) == [(0, 0), (20, 0)]
    assert sd.hilbert_shards(documents(spark, []), scratch(spark)).collect() == []
    clash = documents(spark, ["a"]).withColumn("shard", F.lit("x")).withColumn("__d0", F.lit(3))
    got = sd.sharded_documents(clash, scratch(spark)).collect()[0]
    assert (got.shard, got.slot, got["__d0"], got.text) == (0, 0, 3, "a")


def walked(bits, dims):
    """Each cell's place on the curve, with plain integers."""

    def place(steps):
        x, top = list(steps), 1 << (bits - 1)
        q = top
        while q > 1:
            for i in range(dims):
                if x[i] & q:
                    x[0] ^= q - 1
                else:
                    t = (x[0] ^ x[i]) & (q - 1)
                    x[0], x[i] = x[0] ^ t, x[i] ^ t
            q >>= 1
        for i in range(1, dims):
            x[i] ^= x[i - 1]
        t, q = 0, top
        while q > 1:
            t ^= q - 1 if x[-1] & q else 0
            q >>= 1
        return int("".join(str((v ^ t) >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)

    return {c: place(c) for c in product(range(1 << bits), repeat=dims)}


def test_equals_plain_shards_and_slots(spark):
    texts = [f"word{i % 61} " * (i % 40) for i in range(700)] + ["hot"] * 400 + [None, "", "é" * 30, "long " * 200_000]
    n = len(texts)
    langs, sources = [None if i % 5 == 0 else f"l{i % 3}" for i in range(n)], [f"s{i * i % 23}" if i % 7 else None for i in range(n)]
    rows = []
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        h = xxhash.xxh64_intdigest(raw, 42)
        key = (h - (1 << 64) if h >> 63 else h, zlib.crc32(raw), len(raw) + 16)
        rows.append((key, i, (langs[i], sources[i], math.floor(math.log(key[2]) / math.log(2) * 32))))
    low = lambda v: (v is not None, v)
    steps = []
    for k in range(3):
        values = [r[2][k] for r in rows]
        steps.append({v: sum(low(o) < low(v) for o in values) * 16 // n for v in set(values)})
    least = {}
    for key, _, dims in rows:
        # A least value leaves nulls out, as Spark's does.
        least[key] = [min((v for v in (d, old) if v is not None), default=None) for d, old in zip(dims, least.get(key, dims), strict=True)]
    curve = walked(4, 3)
    order = sorted((curve[tuple(steps[k][least[key][k]] for k in range(3))], *key, i) for key, i, _ in rows)
    want = {}
    for rank, (*_, i) in enumerate(order):
        shard = rank * 40 // n
        want[i] = (shard, rank - -(-shard * n // 40))
    docs = documents(spark, texts, sources=sources, langs=langs).repartition(3)
    assert {r.doc_id: (r.shard, r.slot) for r in sd.hilbert_shards(docs, scratch(spark)).collect()} == want
