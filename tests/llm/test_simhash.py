import random

import numpy as np
import pandas as pd
import xxhash

from sceneloom.llm import simhash as sh
from sceneloom.llm.components import components

from .helpers import documents, scratch


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(ids, fps, bits):
    """Least id that each fingerprint reaches, by comparing all with all."""
    out, left = {}, set(range(len(fps)))
    while left:
        part, edge = set(), {min(left)}
        while edge:
            part |= edge
            edge = {j for i in edge for j in left - part if (fps[i] ^ fps[j]).bit_count() <= bits}
        least = min((ids[i] for i in part if ids[i] is not None), default=None)
        out |= {i: least for i in part}
        left -= part
    return out


def test_fingerprint_equals_plain():
    for text in [None, "", " \n", "One", "one Two", "a b c", "A\tb\x0bc d e É f", "x " * 500]:
        assert sh.fingerprint(text) == plain_fingerprint(text)


def check_links(spark, fps, **limits):
    frame = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "doc_id long, fp long").repartition(3)
    rows = frame.join(_ids(spark, frame, **limits), "fp").collect()
    want = reach(list(range(len(fps))), fps, 3)
    assert {r.doc_id: r.component_id for r in rows} == want


def _ids(spark, frame, few=sh.FEW, block=sh.BLOCK):
    keep = scratch(spark)
    fps = frame.groupBy("fp").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "least")
    roots = components(sh.links(fps.select("fp"), keep, few=few, block=block), keep)
    from pyspark.sql import functions as F

    known = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    return known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")


def near(rng, fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def test_links_equal_all_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = base + [near(rng, rng.choice(base), rng.randint(0, 5)) for _ in range(200)] + [0, 1, (1 << 64) - 1]
    check_links(spark, fps)


def test_crowded_keys_go_in_blocks(spark):
    rng = random.Random(4)
    core = rng.getrandbits(64)
    fps = [near(rng, core, rng.randint(0, 3)) for _ in range(150)] + [core ^ (b << 40) for b in range(1, 60)]
    check_links(spark, fps, few=2, block=16)


def test_long_chains(spark):
    fps, fp = [], 0
    for b in range(0, 60, 3):
        fp |= 7 << b
        fps.append(fp)
    check_links(spark, fps)


def test_documents(spark):
    long = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", "solo", long, long.upper(), long + " w0", "solo", " \n"]
    docs = documents(spark, texts).unionByName(documents(spark, [long])).withColumnRenamed("n_chars", "fp")
    rows = sh.near_duplicates(docs, scratch(spark)).collect()
    want = reach([*range(8), 0], [plain_fingerprint(t) for t in [*texts, long]], 3)
    assert sorted((r.doc_id, r.component_id) for r in rows) == sorted(([*range(8), 0][i], c) for i, c in want.items())
    nulls = documents(spark, ["a", "a"]).selectExpr("cast(null as long) as doc_id", "text")
    assert [r.component_id for r in sh.near_duplicates(nulls, scratch(spark)).collect()] == [None, None]
    assert sh.near_duplicates(documents(spark, []), scratch(spark)).collect() == []


def test_trees_join_what_links():
    rows = pd.DataFrame({"fp": np.array([0, 1, 3, 1 << 20, 7 << 30], np.int64)})
    assert len(sh._trees(rows, 1)) == 3


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def copies(rng, n, cluster=0):
    """Texts and near copies with up to one word in 30 changed, added or dropped; ``cluster`` copies of one text."""
    new = lambda: f"w{rng.randrange(5000)}"
    texts = [[new() for _ in range(rng.randint(60, 400))] for _ in range(n)]
    out = [*texts]
    for text in [*texts[: n // 2], *[texts[0]] * cluster]:
        copy = []
        for w in text:
            kind = rng.random() * rng.choice([30, 60, 120, 240])
            copy += [w] if kind > 1 else rng.choice([[new()], [w, new()], []])
        out.append(copy)
    return [" ".join(t) for t in out]


def groups_of(n, links):
    """Least index of each part of ``links``."""
    root = list(range(n))
    for a, b in links:
        a, b = root[a], root[b]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_wide_fingerprints():
    text = " ".join(f"w{i % 700}" for i in range(2000))
    wide = sh.wide_fingerprint(text)
    assert int(wide[0]) == sh.fingerprint(text, sh.COPY_WIDTH)
    hashes = sh._hashed_again(sh._shingle_hashes(text, sh.COPY_WIDTH), sh.COPY_WORDS)
    assert [int(w) for w in wide] == [int(sh._majority(h)) for h in hashes]
    assert not sh.wide_fingerprint(None).any() and not sh.wide_fingerprint(" ").any()


def test_near_copies_equal_all_pairs(spark):
    rng = random.Random(21)
    for few, block, cluster in ((sh.COPY_FEW, sh.BLOCK, 0), (4, 16, 60)):
        texts = copies(rng, 120, cluster)
        wide = [sh.wide_fingerprint(t) for t in texts]
        most = sh.most_bits(sh.COPY_SIMILARITY, 64 * sh.COPY_WORDS, 2)
        apart = lambda a, b: int(np.bitwise_count(wide[a] ^ wide[b]).sum())
        pairs = [(a, b) for b in range(len(texts)) for a in range(b)]
        near = {p for p in pairs if apart(*p) <= most}
        same = {p for p in pairs if jaccard(shingles(texts[p[0]]), shingles(texts[p[1]])) >= 0.8}
        assert len(same & near) >= 0.97 * len(same)
        # Texts of one first word are one, and the least of their fingerprints stands for them.
        one = {}
        for i, w in enumerate(w.view(np.int64).tolist() for w in wide):
            one[w[0]] = min(one.get(w[0], (w, i)), (w, i))
        frame = spark.createDataFrame([(fp, w) for fp, (w, _) in one.items()], "fp long, wide array<long>")
        keep = scratch(spark)
        found = {r.fp: r.root for r in sh.copy_groups(frame, keep, few=few, block=block).collect()}
        assert len(found) == len(one)
        reached = groups_of(len(texts), near)
        assert all(reached[one[fp][1]] == reached[one[r][1]] for fp, r in found.items())
        root = [min(i for fp, (_, i) in one.items() if found[fp] == found[int(w.view(np.int64)[0])]) for w in wide]
        # Balls of radius 1 around 24 segments: the worst pairs, at 0.8 and two deviations, meet nine times in ten.
        assert len(same) > 40 and sum(root[a] == root[b] for a, b in same) >= 0.9 * len(same)
        if few == sh.COPY_FEW:
            kept = sh.one_of_each(documents(spark, texts), scratch(spark)).collect()
            assert len(kept) == len(set(root))


def test_one_of_each_edges(spark):
    long = " ".join(f"w{i}" for i in range(300))
    docs = documents(spark, [None, "", long, long.upper(), long + " end", "a b", "A  b", "other words"])
    docs = docs.unionByName(docs.filter("doc_id = 2")).unionByName(docs.filter("doc_id = 7").selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars")).withColumnRenamed("n_chars", "wide")
    rows = sh.one_of_each(docs, scratch(spark)).collect()
    assert sorted(r.doc_id for r in rows) == [0, 2, 5, 7] and rows[0].asDict().keys() == {"doc_id", "text", "lang", "source", "wide"}
    assert sh.one_of_each(docs.limit(0), scratch(spark)).collect() == []
