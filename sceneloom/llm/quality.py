"""Quality rules: word and line counts, and divergence from a language's own profile.

A document's character-class histogram and its histogram over the language's
most common words are compared with the language's pooled histograms by
Jensen-Shannon distance (base 2, so 0 to 1). Everything is DataFrame
expressions; a document is judged inside its row, so repeated, null or
clashing ids never meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, words_of

#: One regular-expression class each; a last class holds all other characters.
CHAR_CLASSES = (r"\p{Ll}", r"\p{Lu}", "0-9", r"\x20\x09-\x0D", r".,;:!?'\x22()\-", "#*$%&|<>", r"\x21-\x7E")
SYMBOLS = "#*$%&|<>"
#: Bits that hold a window's place beside its hash.
_PLACE_BITS = 20
MIN_WORDS = 50
COMMON_WORDS = 24
#: Beyond these distances a document is rejected.
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.32
#: Fewer words than this say too little about common words.
MIN_WORDS_FOR_COMMON = 100
#: Languages whose profiles may be broadcast; beyond, the join shuffles.
BROADCAST_LANGUAGES = 10_000


def window_hashes(words: Column) -> Column:
    """64-bit hashes of the 3-word windows, in order; none for under 3 words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    places = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.array(hashes), lambda hs: F.transform(places, lambda i: F.xxhash64(hs[i], hs[i + 1], hs[i + 2])))[0]


def repeated_words(hashes: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, from the windows' ``hashes``.

    A text with as many different hashes as windows repeats none. In the
    others, sorting numbers made of 44 bits of a hash and the place finds the
    places that may repeat; sorted (whole hash, place) pairs of these find
    those that do. Each adds what it covers beyond the one before it. (Two
    windows of a text of 100,000 words share 64 bits by chance once in 10**9.)
    """
    low = F.lit((1 << _PLACE_BITS) - 1).cast("long")
    marked = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))
    beside = lambda xs, f: F.flatten(F.filter(F.zip_with(xs, F.slice(xs, 2, F.size(xs)), f), lambda x: x.isNotNull()))
    likely = F.transform(F.array(marked), lambda xs: F.array_distinct(beside(xs, lambda a, b: F.when(F.shiftright(a.bitwiseXOR(b), _PLACE_BITS) == 0, F.array(a.bitwiseAND(low), b.bitwiseAND(low))))))[0]
    likely = F.when(F.size(hashes) < (1 << _PLACE_BITS), likely.cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(hashes) - 1))
    pairs = F.sort_array(F.transform(likely, lambda i: F.struct(hashes[i].alias("h"), i.alias("i"))))
    hits = F.transform(F.array(pairs), lambda ps: beside(ps, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))[0]
    counted = F.aggregate(
        F.sort_array(hits),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(counted).cast("long")


def class_counts(text: Column) -> list[Column]:
    """Characters of each class; a character counts in the first class that has it."""
    rest, counts = text, []
    for chars in CHAR_CLASSES:
        fewer = F.regexp_replace(rest, f"[{chars}]+", "")
        counts.append(F.char_length(rest) - F.char_length(fewer))
        rest = fewer
    return [*counts, F.char_length(rest)]


def measured(docs: DataFrame, carry: list[str]) -> DataFrame:
    """doc_id, lang, ``_carry``, the words and the counts that need no reference."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # Words, lines and hashes are columns of their own steps: each is made once.
    base = docs.select("doc_id", "lang", text.alias("_text"), words_of(F.col("text")).alias("_words"), lines.alias("_lines"), F.struct(*(carry or ["doc_id"])).alias("_carry"))
    base = base.select("*", window_hashes(F.col("_words")).alias("_hashes"))
    return base.select(
        "doc_id",
        "lang",
        "_carry",
        "_text",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_hashes")).alias("n_repeat_words"),
    )


def language_references(docs: DataFrame, common: int = COMMON_WORDS) -> DataFrame:
    """One row for each language: ``ref_words``, ``ref_word_p`` (their shares, then all others') and ``ref_char_p``.

    Shares are pooled over all documents of the language. Counts are summed
    before and after the shuffle; the ranking keeps ``common`` words of each
    partition before it meets those of others.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    counts = [F.sum(c).alias(f"_c{k}") for k, c in enumerate(class_counts(F.col("_text")))]
    chars = docs.select("lang", text.alias("_text")).groupBy("lang").agg(*counts)
    total = reduce(lambda a, b: a + b, [F.col(f"_c{k}") for k in range(len(counts))])
    chars = chars.select("lang", F.array(*[F.col(f"_c{k}") / F.greatest(total, F.lit(1)) for k in range(len(counts))]).alias("ref_char_p"))
    words = docs.select("lang", F.explode(words_of(F.lower("text"))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    sums = words.groupBy("lang").agg(F.sum("n").alias("total"))
    top = words.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("k") <= common)
    listed = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "word", "n"))).alias("top"))
    shares = listed.join(sums, listed["lang"].eqNullSafe(sums["lang"])).select(
        listed["lang"],
        F.col("top.word").alias("ref_words"),
        F.array_max(F.transform("top.word", lambda w: F.char_length(w))).alias("ref_chars"),
        F.concat(F.transform("top.n", lambda n: n / F.col("total")), F.array((F.col("total") - F.aggregate("top.n", F.lit(0).cast("long"), lambda a, n: a + n)) / F.col("total"))).alias("ref_word_p"),
    )
    return chars.join(shares, chars["lang"].eqNullSafe(shares["lang"]), "left").select(chars["lang"].alias("ref_lang"), "ref_char_p", "ref_words", "ref_chars", "ref_word_p")


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of the same length, each of sum 1 (or all 0: distance null)."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    total = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.abs(total) / 2)


def passing_documents(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return quality_rules(docs, scratch, carry=docs.columns, **options).filter("kept").select("_carry.*")


def quality_rules(
    docs: DataFrame,
    scratch: Scratch,
    max_char: float = MAX_CHAR_DISTANCE,
    max_word: float = MAX_WORD_DISTANCE,
    min_common: int = MIN_WORDS_FOR_COMMON,
    carry: list[str] | None = None,
) -> DataFrame:
    """doc_id, the five counts, base_failed, both distances and kept, for each row of ``docs``.

    base_failed: under 50 words, or over half of them inside repeated
    windows. kept: not base_failed and neither distance beyond its limit; the
    word distance is judged from ``min_common`` words on, and a distance that
    has no reference (null language among none, empty text) is null and
    doesn't reject. Null and empty texts have no words and fail. Repeated rows
    are judged alike; an empty table gives no rows. ``carry`` names columns of
    ``docs`` to return in a struct ``_carry``.
    """
    refs = scratch.keep(language_references(docs), "languages")
    if refs.count() <= BROADCAST_LANGUAGES:
        refs = F.broadcast(refs)
    rows = measured(docs, carry or [])
    rows = rows.join(refs, rows["lang"].eqNullSafe(refs["ref_lang"]), "left")
    # Most words are longer than any common one.
    place = lambda w: F.when(F.char_length(w) <= F.col("ref_chars"), F.coalesce(F.array_position(F.col("ref_words"), F.lower(w)).cast("int"), F.lit(0))).otherwise(0)
    found = F.transform("_words", place)
    rows = rows.select("*", found.alias("_found"), F.array(*class_counts(F.col("_text"))).alias("_chars"))
    # Sorted behind one of each place, equal places stand together: where each begins tells how many there are.
    rows = rows.select("*", F.sort_array(F.concat(F.sequence(F.lit(0), F.lit(COMMON_WORDS + 1)), "_found")).alias("_sorted"))
    begins = F.array(*[F.array_position("_sorted", k).cast("int") for k in range(COMMON_WORDS + 2)])
    n = F.col("n_words")
    rows = rows.select("*", begins.alias("_begins"))
    of = F.zip_with("_begins", F.slice("_begins", 2, COMMON_WORDS + 1), lambda a, b: b - a - 1)
    rows = rows.select("*", of.alias("_of"))
    rows = rows.select("*", F.concat(F.slice("_of", 2, F.size("ref_words")), F.slice("_of", 1, 1)).alias("_hist"))
    share = lambda counts, total: F.transform(counts, lambda c: c / F.greatest(total, F.lit(1)))
    rows = rows.select(
        "*",
        ((n < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * n)).alias("base_failed"),
        F.when(n > 0, divergence(share(F.col("_chars"), F.char_length("_text")), F.col("ref_char_p"))).alias("char_distance"),
        F.when(n >= min_common, divergence(share(F.col("_hist"), n), F.col("ref_word_p"))).alias("word_distance"),
    )
    far = F.coalesce(F.col("char_distance") > max_char, F.lit(False)) | F.coalesce(F.col("word_distance") > max_word, F.lit(False))
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    # As the row of a one-row table: a filter on the verdict is then not worked out again at each step below.
    kept = F.inline(F.array(F.struct((~F.col("base_failed") & ~far).alias("kept"))))
    return rows.select(*out, "char_distance", "word_distance", *(["_carry"] if carry else []), kept)
