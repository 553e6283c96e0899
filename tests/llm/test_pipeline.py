import random

import numpy as np

import corpus_pipeline as cp
from sceneloom.llm import decontaminate as dc
from sceneloom.llm import simhash as sh

from .helpers import SCHEMA
from .test_decontaminate import plain_score
from .test_quality import plain_counts, prose
from .test_simhash import groups_of


def corpus():
    rng = random.Random(12)
    items = [prose(rng, 30) for _ in range(4)]
    texts = [prose(rng, rng.randint(80, 160)) for _ in range(120)]
    own = [prose(rng, 100) for _ in range(3)]
    leaked = [own[0] + " " + items[0], items[1] + " " + own[1], own[2] + " " + " ".join(w if k % 9 else "edit" for k, w in enumerate(items[2].split()))]
    copies = [texts[5], texts[5], texts[6] + " end", texts[7].upper()]
    junk = ["short one", None, "", "same words here " * 40, " ".join(w + "$$$" for w in texts[8].split())]
    return items, texts, leaked, copies, junk


def test_stages_equal_brute_force(spark, tmp_path):
    items, texts, leaked, copies, junk = corpus()
    all_texts = texts + leaked + copies + junk
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(all_texts)]
    rows.append(rows[9])
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {k: sorted(r.doc_id for r in v) for k, v in seen.items()}
    good = sorted(r[0] for r in rows if not plain_counts(r[1])[5] and not {127, 128, 129, 130, 131} & {r[0]} - {126})
    clean_ids = [i for i in ids["quality"]]
    assert set(range(126)) <= set(clean_ids) and not {127, 128, 129, 130, 131} & set(clean_ids)
    assert len(good) >= len(clean_ids) - 1
    by = {r[0]: r[1] for r in rows}
    kept = sorted(set(clean_ids))
    wide = [sh.wide_fingerprint(by[i]) for i in kept]
    most = sh.most_bits(0.8, 64 * sh.COPY_WORDS, 2)
    least = groups_of(len(kept), [(a, b) for b in range(len(kept)) for a in range(b) if np.bitwise_count(wide[a] ^ wide[b]).sum() <= most])
    assert len(set(least)) < len(kept) and ids["near_dedup"] == sorted({kept[k] for k in least})
    copied = {i for i in ids["near_dedup"] if any(plain_score(dc.words_in(item), dc.words_in(by[i])) >= dc.LEAST_SCORE for item in items)}
    assert {120, 121, 122} & set(ids["near_dedup"]) == copied
    assert ids["decontaminate"] == [i for i in ids["near_dedup"] if i not in copied]
    assert set(ids["mix"]) <= set(ids["decontaminate"]) and ids["shard"] == ids["mix"]
    counts = [sum(r.shard == s for r in seen["shard"]) for s in range(40)]
    assert max(counts) - min(counts) <= 1
    assert sorted(map(tuple, cp.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, seen["shard"]))


def test_stages_take_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
