import random

from pyspark.sql import functions as F

from sceneloom.llm import decontaminate as dc

from .helpers import documents, scratch
from .test_quality import prose


def plain_score(item, text):
    """Cell by cell, over the whole text."""
    best, above = 0, [0] * (len(text) + 1)
    for w in item:
        row = [0]
        for j, t in enumerate(text, 1):
            row.append(max(0, above[j] + dc.GAP, row[-1] + dc.GAP, above[j - 1] + (dc.MATCH if t == w else dc.MISMATCH)))
        best, above = max(best, *row), row
    return best / (dc.MATCH * len(item)) if item else 0


def edit(rng, text, share):
    out = []
    for w in text.split():
        r = rng.random()
        out += [] if r < share / 3 else ["xx"] if r < 2 * share / 3 else [w, "yy"] if r < share else [w]
    return " ".join(out)


def test_equals_alignment_of_all_with_all(spark):
    rng = random.Random(21)
    items = [prose(rng, rng.randint(8, 50)) for _ in range(12)] + ["too Short", "one", "a b c, d e f g", None, "", " . "]
    items.append(items[0])
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(50)]
    for k in range(60):
        texts.append(f"{prose(rng, 40)} {edit(rng, items[k % 12], rng.choice([0, 0.1, 0.25, 0.5]))} {prose(rng, 20)}")
    texts += [items[1] + " " + items[2], items[3].upper().replace(" ", ", "), " ".join(items[4].split()[: len(items[4].split()) * 2 // 3]), None, "", items[5], items[5], "it is TOO. short", "too very short", "A b c d e f G h a b c d e f g", "a b c d e f", "one"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in dc.matches(documents(spark, texts), benchmark).collect()}
    want = {}
    for i, item in enumerate(items):
        words = dc.words_in(item)
        for d, text in enumerate(texts):
            score = plain_score(words, dc.words_in(text))
            if words and score * dc.MATCH * len(words) >= dc.least_score(len(words)):
                want[d, i] = score
    # A copy so edited that none of its seeds is left can't be found.
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert len(got) >= 0.9 * len(want) and {k for k, s in want.items() if s >= 0.6} <= set(got)
    # No bit of the map, group or broadcast changes what is found.
    apart = dc.matches(documents(spark, texts), benchmark, bits=6, pairs=3, broadcast_rows=0)
    assert {(r.doc_id, r.item_id): r.score for r in apart.collect()} == got
    free = {r.doc_id for r in dc.clean(documents(spark, texts).withColumn("score", F.lit(1)), benchmark).collect()}
    assert free == set(range(len(texts))) - {d for d, _ in got}


def test_no_items_and_no_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    assert dc.matches(documents(spark, ["a b c"]), none).collect() == []
    assert dc.matches(documents(spark, []), one).collect() == []
    assert dc.clean(documents(spark, ["a"]), none).count() == 1
    rows = dc.matches(documents(spark, ["a b c d e f g h i"] * 2).withColumn("doc_id", F.lit(None).cast("long")), one).collect()
    assert [(r.doc_id, r.item_id, r.score, r.start_word, r.end_word) for r in rows] == [(None, 1, 1.0, 0, 9)] * 2


def test_one_law_for_short_items(spark):
    items = ["one", "too Short", "a b c", "a b c, d", "e f g h i", "j k l m n o", "p q r s t u v"]
    texts = ["One.", "two ones", "is TOO. short", "too very short", "x a b c x", "a b x c", "a B c d", "a b c x d", "e x f g h i", "e f g h x", "j k x m n o", "j k x m x o", "p q r s", "p q r x t u v", "p q x s x u v", "p x r x t x v", "v u t s r q p"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.matches(documents(spark, texts), benchmark).collect()}
    plain = {(d, i) for d, t in enumerate(texts) for i, w in enumerate(map(dc.words_in, items)) if plain_score(w, dc.words_in(t)) * dc.MATCH * len(w) >= dc.least_score(len(w))}
    assert got == plain == {(0, 0), (2, 1), (4, 2), (6, 2), (7, 2), (6, 3), (8, 4), (9, 4), (10, 5), (12, 6), (13, 6), (14, 6)}


def test_items_of_one_stem_are_not_all_tried(spark):
    stem = "which of the following statements is true"
    items = [f"{stem} {' '.join(f'w{i}x{k}' for k in range(51))}" for i in range(4000)]
    texts = [f"{stem} {' '.join(f'other{k}' for k in range(51))}", "before " + items[7] + " after"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs, held = documents(spark, texts), scratch(spark)
    _, numbered = dc._numbered_items(benchmark, held)
    assert dc.candidates(docs, numbered, held)[0].count() <= 2
    assert [(r.doc_id, r.item_id, r.score, r.start_word, r.end_word) for r in dc.matches(docs, benchmark).collect()] == [(1, 7, 1.0, 1, 59)]


def test_long_texts_and_clashing_columns(spark):
    rng = random.Random(8)
    item = prose(rng, 40)
    long = " ".join(f"n{rng.randrange(50000)}" for _ in range(400_000))
    texts = [f"{long} {item} {long}", long, item, ""]
    docs = documents(spark, texts).withColumns({c: F.lit(1) for c in ("item", "key", "text_key", "group", "words", "item_id")})
    benchmark = spark.createDataFrame([(1, item, 5)], "item_id long, text string, doc_id long")
    assert sorted((r.doc_id, r.item_id, r.score, r.start_word) for r in dc.matches(docs, benchmark).collect()) == [(0, 1, 1.0, 400_000), (2, 1, 1.0, 0)]
    free = dc.clean(docs, benchmark)
    assert free.columns == docs.columns and sorted(r.doc_id for r in free.collect()) == [1, 3]
