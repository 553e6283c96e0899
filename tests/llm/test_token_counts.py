import random

import numpy as np
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sceneloom.llm import token_counts as tc

from .helpers import documents

RANKS = open(tc.RANKS_FILE, "rb").read()
COUNTER = tc.Counter(RANKS)


def full(text):
    return len(COUNTER.encoding.encode_ordinary(text))


TEXT = st.text(alphabet="ab Z19 .,'\n\té日", max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.sampled_from([1, 2, 4]), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 30), TEXT), max_size=8))
def test_edits_equal_full_encoding(text, size, edits):
    chars, tokens = COUNTER.leaves(text, size)
    tree = tc.Tree(chars, tokens)
    assert tree.tokens == full(text)
    for start, n, put in edits:
        start = min(start, len(text))
        text, _ = tc.edited(text, tree, COUNTER, start, min(start + n, len(text)), put, size)
        assert (tree.chars, tree.tokens) == (len(text), full(text))


SPLIT = regex.compile(tc.PATTERN)
PARTS = ["a", "Zé", "ll", " ", "  ", "\n", "\n\n \t", "'", "'s", "'ll", "'re", "1", "23", ".", "!'", "日", " x"]


def fuzz(seed, rounds, last_first=False):
    """Random edits, long deletions and runs of blanks among them, on leaves of 1, 2 and 4 pre-tokens."""
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice(PARTS) for _ in range(rng.randint(0, n)))
    done = 0
    while done < rounds:
        size, text = rng.choice([1, 2, 4]), some(30)
        tree = tc.Tree(*COUNTER.leaves(text, size))
        spans = []
        for _ in range(rng.randint(1, 8)):
            start = rng.randint(0, len(text))
            spans.append((start, min(len(text), start + rng.choice([0, 1, 2, 5, 20])), some(rng.choice([0, 2, 12]))))
        if last_first:
            spans.sort(reverse=True)
        upto = len(text)
        for start, end, put in spans:
            start, end = (min(start, upto), min(end, upto)) if last_first else (min(start, len(text)), min(end, len(text)))
            upto = start
            text, _ = tc.edited(text, tree, COUNTER, start, end, put, size)
            pieces = SPLIT.findall(text)
            assert tree.chars == len(text) and tree.tokens == sum(COUNTER[p] for p in pieces)
            assert tree.leaves == 1 or (tree.sums[tree.width : tree.width + tree.leaves, 0] > 0).all()
            done += 1


@pytest.mark.parametrize("last_first", [False, True])
def test_many_random_edits(last_first):
    fuzz(5, 10_000, last_first)


def test_leaves_keep_their_size():
    text = "one two three " * 50
    tree = tc.Tree(*COUNTER.leaves(text))
    for _ in range(20):
        text, _ = tc.edited(text, tree, COUNTER, 100, 100, "more words here " * 200)
    assert tree.tokens == full(text) and tree.leaves > 20 * 600 / tc.LEAF / 3
    text, _ = tc.edited(text, tree, COUNTER, 3, len(text) - 3, "")
    assert tree.tokens == full(text) and tree.leaves <= 2


def test_small_edit_of_long_text_encodes_little():
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "beta", "12", "gamma."]) for _ in range(20_000))
    tree = tc.Tree(*COUNTER.leaves(text))
    new, again = tc.edited(text, tree, COUNTER, 50_000, 50_010, "new words")
    assert tree.tokens == full(new) and again < 2_000


def test_query_equals_brute_force(spark):
    texts = ["mail me at a.b@c.example or 123456 now", None, "", "12345", "x" * 3000 + "99999", "no change", "no change"]
    rows = sorted(tc.redacted_counts(documents(spark, texts)).collect())
    assert len(rows) == len(texts)
    for row, text in zip(rows, texts, strict=True):
        text = text or ""
        after = tc.REDACTED.sub(lambda m: "<mail>" if "@" in m[0] else "<number>", text)
        assert (row.n_chars, row.n_tokens, row.n_chars_after, row.n_tokens_after) == (len(text), full(text), len(after), full(after))
    assert tc.redacted_counts(documents(spark, [])).collect() == []
    plain = tiktoken.Encoding("x", pat_str=tc.PATTERN, mergeable_ranks=COUNTER.encoding._mergeable_ranks, special_tokens={})
    assert rows[0].n_tokens == len(plain.encode_ordinary(texts[0]))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64])
def test_tree_finds_leaves(n):
    chars = np.array([(i * 7) % 5 for i in range(n)])
    tree = tc.Tree(chars, chars)
    # Empty leaves are left out, unless there are no others.
    chars = chars[chars > 0] if chars.any() else chars[:1]
    assert tree.leaves == len(chars)
    for c in range(int(chars.sum())):
        leaf, at = tree.leaf_at(c)
        assert at == chars[:leaf].sum() and at <= c < at + chars[leaf]


def test_many_edits_encode_no_more_than_the_text(spark):
    """Edits all over a long text, some at one place; merged or not they give the same text."""
    rng = random.Random(3)
    text = " ".join(rng.choice(["alpha", "beta", "12", "gamma."]) for _ in range(60_000))
    starts = sorted(rng.sample(range(len(text) - 10), 8000))
    edits = [(a, min(a + rng.choice([0, 1, 3]), b), rng.choice(["", "x", " new 7"])) for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
    edits = sorted([*edits, (starts[5], starts[5], "b"), (starts[5], starts[5], "a")])
    want = text
    for start, end, put in reversed(edits):
        want = want[:start] + put + want[end:]
    for near in (0, 50, 10**9):
        got = text
        for start, end, put in reversed(tc.merged(text, edits, near)):
            got = got[:start] + put + got[end:]
        assert got == want
    rows = tc.build_trees(documents(spark, [text]))
    listed = spark.createDataFrame([([{"start": a, "end": b, "put": p} for a, b, p in edits],)], f"edits {tc.EDIT}")
    row = tc.apply_edits(rows.crossJoin(listed)).first()
    assert (row.n_chars_after, row.n_tokens_after, row.n_edits) == (len(want), full(want), 8002)
    assert row.n_chars_encoded <= 1.1 * len(want)
