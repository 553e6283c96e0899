from fractions import Fraction

from pyspark.sql import functions as F

from sceneloom.llm import mixing as mx

from .helpers import documents, scratch


def plain_seats(targets, n):
    got = [0] * len(targets)
    for _ in range(n):
        i = max(range(len(targets)), key=lambda i: (Fraction(targets[i]) / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


def test_seats_equal_one_by_one(spark):
    for targets, n in [([5.0, 3.0, 1.0], 7), ([1.0] * 9, 4), ([100.0, 1.0, 1.0, 1.0, 0.0], 13), ([0.3, 0.3, 0.3], 100), ([7.0] + [0.4] * 30, 11), ([3.0, 0.0], 0), ([0.0], 5)]:
        frame = spark.createDataFrame(list(enumerate(targets)), "place long, target double")
        houses = sorted({0, n // 3, n // 2, n})
        rows = mx.seats_at(frame, houses).collect()
        for k, h in enumerate(houses):
            want = plain_seats(targets, h) if any(targets) else [0]
            assert [r.seats for r in sorted(r for r in rows if r.house == k)] == want, (targets, h)


def test_shard_quotas_add_up(spark):
    frame = spark.createDataFrame(list(enumerate([50.0, 30.0, 9.0])), "place long, target double")
    rows = sorted(mx.shard_quotas(frame, 40, 4).collect())
    assert all(q >= 0 for r in rows for q in r.quotas)
    assert [sum(r.quotas[s] for r in rows) for s in range(4)] == [10] * 4
    for s in range(4):
        assert [r.upto[s] for r in rows] == [sum(r.quotas[: s + 1]) for r in rows] == plain_seats([50.0, 30.0, 9.0], 10 * (s + 1))


def test_targets_stop_and_reshare(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 5), (None, 985)]
    rows = mx.source_targets(spark.createDataFrame(sizes, "source string, source_size long"), scratch(spark)).collect()
    got = {r.source: (r.weight, r.target) for r in rows}
    # Weights 5, 2, 1 and, for null in the last place, 5 again.
    left = 2000 - 30 - 15
    assert got == {"a": (5, 30.0), "b": (2, left * 2 / 7), "c": (1, 15.0), None: (5, left * 5 / 7)}


def test_mix(spark):
    texts = [("w " * (i % 40 + 1)) for i in range(900)] + [None, "", "one"]
    sources = ["hot" if i % 3 == 0 else ("tiny" if i % 100 == 1 else None if i % 7 == 0 else f"s{i % 4}") for i in range(903)]
    docs = documents(spark, texts, sources)
    rows = mx.mix(docs.repartition(4), scratch(spark)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(903))
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    for source in set(sources):
        mine = [r for r in rows if r.source == source]
        assert sum(r["size"] for r in mine) == mine[0].source_size
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 3 * mx.BLOCK
    assert all((r.first_shard is None) == (r.taken == 0) and (r.taken == 0 or 0 <= r.first_shard <= r.last_shard < mx.SHARDS) for r in rows)
    again = {r.doc_id: r.taken for r in mx.mix(docs.repartition(2), scratch(spark)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_edges(spark):
    assert mx.mix(documents(spark, []), scratch(spark)).collect() == []
    rows = mx.mix(documents(spark, [None, " "]), scratch(spark)).collect()
    assert {(r["size"], r.target, r.taken) for r in rows} == {(0, 0.0, 0)}
    same = documents(spark, ["a b c"] * 3).withColumn("doc_id", F.lit(None).cast("long")).withColumn("target", F.lit("x"))
    assert sum(r.taken for r in mx.mix(same, scratch(spark)).collect()) == 9
    rows = mx.mixed_documents(same, scratch(spark)).collect()
    assert len(rows) == 3 and rows[0].target == "x"


def test_picks_fill_the_shards_quotas(spark):
    """Blocks picked one by one by plain code, and the shards that their picks go to."""
    texts = ["w " * (i * 7 % 53) for i in range(200)]
    docs = documents(spark, texts, [["a", "b", None][min(i % 5, 2)] for i in range(200)])
    keep = scratch(spark)
    rows = mx.mix(docs, keep, shards=5).collect()
    quotas = {r.source: r for r in spark.read.parquet(keep.paths["quotas"]).collect()}
    placed = spark.read.parquet(keep.paths["placed"]).collect()
    for source, quota in quotas.items():
        words = [r.doc_id for r in sorted((r for r in placed if r.source == source), key=lambda r: r["__before"]) for _ in range(r["size"])]
        n, q, off = quota["__n"], quota["__q"], quota["__offset"]
        picked = [b for b in range(n) for _ in range(q // n + ((b + 1) * (q % n) + off) // n - (b * (q % n) + off) // n)]
        assert len(picked) == q == quota["__upto"][-1]
        taken, shards = {}, {}
        for k, b in enumerate(picked):
            s = next(s for s, u in enumerate(quota["__upto"]) if k < u)
            for d in words[b * mx.BLOCK : (b + 1) * mx.BLOCK]:
                taken[d] = taken.get(d, 0) + 1
                shards.setdefault(d, set()).add(s)
        for r in rows:
            if r.source == source:
                assert r.taken == taken.get(r.doc_id, 0)
                assert (r.first_shard, r.last_shard) == ((min(shards[r.doc_id]), max(shards[r.doc_id])) if r.doc_id in shards else (None, None))


def test_whole_documents_come_to_the_targets(spark):
    sizes = [i % 90 + 1 for i in range(600)] + [4000, 3000, 2500]
    docs = documents(spark, ["w " * n for n in sizes], [["big", "mid", "few"][0 if i >= 600 or i % 2 else 1 + (i % 20 == 0)] for i in range(603)])
    keep = scratch(spark)
    rows = mx.mixed_documents(docs, keep).collect()
    for r in spark.read.parquet(keep.paths["quotas"]).collect():
        largest = max(sizes[d.doc_id] for d in docs.filter(F.col("source") == r.source).collect())
        got = sum(sizes[x.doc_id] for x in rows if x.source == r.source)
        assert abs(got - r.target) < 2 * largest + 2 * mx.BLOCK
    alike = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert len(mx.mixed_documents(alike, scratch(spark)).collect()) > 300
