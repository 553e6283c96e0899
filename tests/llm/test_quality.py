import math
import random
from collections import Counter

from pyspark.sql import functions as F

from sceneloom.llm import quality as ql

from .helpers import documents, scratch


def plain_counts(text):
    text = text or ""
    breaks = " \t\n\x0b\x0c\r"
    words, word = [], ""
    for c in text + " ":
        if c in breaks:
            words += [word] if word else []
            word = ""
        else:
            word += c
    lines = [x for x in text.split("\n") if any(c not in breaks for c in x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_counts_equal_plain(spark):
    rng = random.Random(2)
    words = ["a", "b", "cc", "é#", "x|y", "<p>"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t", "\r\n", " \x0b"]) for _ in range(rng.randint(0, 90))) for _ in range(80)]
    texts += [None, "", " \n", "\n".join(["same line"] * 40), "a a a a", "a b c", "x" * 5000, "  a b"]
    rows = sorted(ql.quality_rules(documents(spark, texts), scratch(spark)).collect())
    for row, text in zip(rows, texts, strict=True):
        assert tuple(row)[1:7] == plain_counts(text), repr(text)
        assert not (row.base_failed and row.kept)


def prose(rng, n):
    common = ["the", "of", "and", "to", "in", "is", "it", "for"]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(n))


def test_far_texts_go_and_clean_ones_stay(spark):
    rng = random.Random(6)
    texts = [prose(rng, 200) for _ in range(60)] + [prose(rng, 200).upper(), " ".join(w + "$$$" for w in prose(rng, 200).split()), " ".join("zq" + w for w in prose(rng, 200).split())]
    rows = sorted(ql.quality_rules(documents(spark, texts), scratch(spark)).collect())
    assert all(r.kept for r in rows[:60]) and not any(r.kept for r in rows[60:])
    assert rows[60].char_distance > 0.3 and rows[62].word_distance > 0.32


def test_word_distance_counts_24_words(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choices(words, weights=range(40, 10, -1), k=120)) for _ in range(20)] + ["W5 w29 " * 60, "q " * 120, " ".join(words[16:24] * 15)]
    rows = sorted(ql.quality_rules(documents(spark, texts, langs=["en"] * 22 + ["fr"]), scratch(spark)).collect())
    for mine in (range(22), [22]):
        pool = Counter(w for i in mine for w in texts[i].lower().split())
        top = sorted(pool, key=lambda w: (-pool[w], w))[:24]
        shares = lambda c: [x / c.total() for x in [*(c[w] for w in top), c.total() - sum(c[w] for w in top)]]
        for i in mine:
            p, q = shares(Counter(texts[i].lower().split())), shares(pool)
            part = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0
            want = math.sqrt(abs(sum(part(a, b) + part(b, a) for a, b in zip(p, q, strict=True))) / 2)
            assert abs(rows[i].word_distance - want) < 1e-9, i


def test_divergence(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.5, 0.5], None)], "p array<double>, q array<double>")
    assert [r.d for r in rows.select(ql.divergence(F.col("p"), F.col("q")).alias("d")).collect()] == [1.0, 0.0, None]


def test_null_language_repeats_clashes_and_no_rows(spark):
    rng = random.Random(8)
    texts = [prose(rng, 120)] * 2 + [prose(rng, 120) for _ in range(9)]
    docs = documents(spark, texts, langs=[None] * 5 + ["xx"] * 6).withColumn("kept", F.lit("mine")).withColumn("doc_id", F.lit(7).cast("long"))
    rows = ql.quality_rules(docs, scratch(spark), carry=docs.columns).collect()
    assert len(rows) == 11 and all(r.kept for r in rows) and {r._carry.kept for r in rows} == {"mine"}
    assert ql.quality_rules(documents(spark, []), scratch(spark)).collect() == []


def test_main_path_has_no_python(spark):
    plan = ql.quality_rules(documents(spark, ["a"]), scratch(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
