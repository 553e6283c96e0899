"""Edit-aware token counts.

A document keeps a segment tree over its pre-tokens: leaves of up to
``LEAF`` pre-tokens with their characters and tokens, and sums above them.
An edit is found by going down the sums of characters; only the leaves it
touches, one leaf before and as many after as it takes until old and new
pre-tokens begin at the same place again are encoded anew, and the sums on
the way up are updated. No leaf is empty but the one of an empty text, and
where leaves would grow or shrink too much the tree is laid out again from
the leaves' sums.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level vocabulary splits a text before its merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 64
#: Edits fewer leaves apart are applied as one: each takes the leaf before, its own and the next ones with it.
LEAVES_NEAR = 4
#: Different pre-tokens whose counts one task remembers.
REMEMBERED = 200_000
TREE = "leaf_chars array<int>, leaf_tokens array<int>"
EDIT = "array<struct<start:int,end:int,put:string>>"


class Counter(dict):
    """Tokens of a pre-token."""

    def __init__(self, ranks: bytes):
        super().__init__()
        self.split = regex.compile(PATTERN).findall
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = n = len(self.encoding.encode_ordinary(piece))
        return n

    def leaves(self, text: str, size: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of each run of ``size`` pre-tokens; an empty text has one empty leaf."""
        pieces = self.split(text)
        if not pieces:
            return np.zeros(1, np.int64), np.zeros(1, np.int64)
        cuts = np.arange(0, len(pieces), size)
        chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tokens = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        return np.add.reduceat(chars, cuts), np.add.reduceat(tokens, cuts)


class Tree:
    """Sums of characters and tokens over leaves, as one heap: node i has the children 2i and 2i+1."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self._lay_out(chars, tokens)

    def _lay_out(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        full = chars > 0
        chars, tokens = (chars[full], tokens[full]) if full.any() else (chars[:1], tokens[:1])
        self.leaves = len(chars)
        self.width = 1 << max(0, self.leaves - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + self.leaves] = np.stack([chars, tokens], 1)
        level = self.width
        while level > 1:
            below = self.sums[level : 2 * level]
            level //= 2
            self.sums[level : 2 * level] = below[0::2] + below[1::2]

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and where that leaf begins; the last leaf holds the end."""
        node, at = 1, 0
        while node < self.width:
            left = int(self.sums[2 * node, 0])
            if char < at + left:
                node = 2 * node
            else:
                node, at = 2 * node + 1, at + left
        leaf = node - self.width
        if leaf >= self.leaves:
            leaf = self.leaves - 1
            at = self.chars - int(self.sums[self.width + leaf, 0])
        return leaf, at

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.width + leaf
        change = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def replace(self, first: int, last: int, chars: list[int], tokens: list[int]) -> None:
        """Other leaves for those from ``first`` to ``last``. As many are put in place, else the tree is laid out again."""
        if len(chars) == last - first + 1 and min(chars) > 0:
            for leaf, (c, t) in enumerate(zip(chars, tokens, strict=True), first):
                self.put(leaf, c, t)
            return
        old = self.sums[self.width : self.width + self.leaves]
        self._lay_out(*np.concatenate([old[:first], np.array([chars, tokens], np.int64).T.reshape(-1, 2), old[last + 1 :], np.zeros((1, 2), np.int64)]).T)

    def size_of(self, leaf: int) -> int:
        return int(self.sums[self.width + leaf, 0])


def edited(text: str, tree: Tree, counter: Counter, start: int, end: int, put: str, size: int = LEAF) -> tuple[str, int]:
    """The text with [start, end) replaced, and the characters that were split anew; the tree, of leaves of about ``size``, is updated.

    Where a pre-token begins hangs on what follows alone. So all before one
    stays if what it looked at stays: it looks no further than the next
    pre-token and one character.
    """
    new = text[:start] + put + text[end:]
    shift = len(new) - len(text)
    # The pre-token before the edit may reach into it, and what ends one looks one character ahead.
    first, at = tree.leaf_at(max(start - 1, 0))
    if first:
        first, at = first - 1, at - tree.size_of(first - 1)
    last, begins = tree.leaf_at(max(end - 1, 0))
    until = begins + tree.size_of(last)
    while True:
        more = min(last + 1, tree.leaves - 1)
        # Split through the next leaf too: its start is sure only with what follows.
        reach = until + (tree.size_of(more) if more > last else 0) + shift
        pieces = counter.split(new[at : reach + 1]) if reach < len(new) else counter.split(new[at:])
        ends = at + np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        n = int(np.searchsorted(ends, until + shift))
        if until >= end and (until + shift == len(new) or n < len(ends) - 1 and ends[n] == until + shift):
            break
        if more == last:
            n = len(ends)
            break
        last, until = more, until + tree.size_of(more)
    pieces = pieces[: n + 1] if len(pieces) else []
    had, needs = last - first + 1, -(-len(pieces) // size)
    # Leaves of up to twice the size, or half of it, stay as many as they are.
    into = had if had <= len(pieces) and needs <= 2 * had <= 4 * needs else needs
    cuts = np.linspace(0, len(pieces), into + 1).astype(int)
    runs = [pieces[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    tree.replace(first, last, [sum(map(len, r)) for r in runs], [sum(counter[p] for p in r) for r in runs])
    return new, until + shift - at


def merged(text: str, edits: list[tuple[int, int, str]], near: int) -> list[tuple[int, int, str]]:
    """``edits``, in ascending order, those within ``near`` characters of the one before as one with it: what stands between is put again."""
    out: list[list] = []
    for start, end, put in edits:
        if out and start - out[-1][1] <= near:
            out[-1][2] += [text[out[-1][1] : start], put]
            out[-1][1] = end
        else:
            out.append([start, end, [put]])
    return [(start, end, "".join(put)) for start, end, put in out]


def build_trees(docs: DataFrame, ranks_file: str = RANKS_FILE, carry: list[str] | None = None, edits_of: Callable[[str], list[dict]] | None = None) -> DataFrame:
    """doc_id, text, the leaves of the text's tree, the columns ``carry``, and ``edits`` if ``edits_of`` finds them in the text.

    A null text is empty, of one empty leaf.
    """
    ranks, extra = open(ranks_file, "rb").read(), carry or []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(ranks)
        for rows in batches:
            chars, tokens = zip(*[counter.leaves(t) for t in rows["text"]], strict=True) if len(rows) else ((), ())
            found = {"edits": [edits_of(t) for t in rows["text"]]} if edits_of else {}
            yield rows.assign(leaf_chars=list(chars), leaf_tokens=list(tokens), **found)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *extra)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{kinds}, {TREE}" + (f", edits {EDIT}" if edits_of else ""))


def apply_edits(trees: DataFrame, ranks_file: str = RANKS_FILE) -> DataFrame:
    """Counts before and after the ``edits`` (``EDIT``, code points of the text) of each row of ``trees``.

    Edits must not overlap; of edits at one place the one that ends first
    comes first, and equal ones count each. Edits a few leaves apart are
    applied together, so that no part is encoded again and again, and these from the last to the first. A null list is none. Rows that repeat are counted each; no rows
    give none.
    """
    ranks = open(ranks_file, "rb").read()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(ranks)
        for rows in batches:
            out = []
            for doc, text, chars, tokens, edits in zip(rows["doc_id"].astype("Int64"), rows["text"], rows["leaf_chars"], rows["leaf_tokens"], rows["edits"], strict=True):
                edits = [] if edits is None else sorted((e["start"], e["end"], e["put"]) for e in edits)
                before, n_chars, again = int(np.sum(tokens)), len(text), 0
                tree = Tree(np.asarray(chars, np.int64), np.asarray(tokens, np.int64)) if edits else None
                # An edit takes some leaves around it with it: those that would take the same ones are one.
                for edit in reversed(merged(text, edits, LEAVES_NEAR * n_chars // len(chars))):
                    text, split = edited(text, tree, counter, *edit)
                    again += split
                out.append((doc, n_chars, before, len(edits), len(text), tree.tokens if edits else before, again, len(chars)))
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "n_tokens", "n_edits", "n_chars_after", "n_tokens_after", "n_chars_encoded", "n_leaves"]).astype({"doc_id": "Int64"})

    names = ("n_chars", "n_tokens", "n_edits", "n_chars_after", "n_tokens_after", "n_chars_encoded", "n_leaves")
    return trees.mapInPandas(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


#: What a redaction replaces: mail addresses, and numbers of five digits and more.
REDACTED = regex.compile(r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+|[0-9]{5,}")


def redactions(text: str) -> list[dict]:
    """The edits that redact a text."""
    return [{"start": m.start(), "end": m.end(), "put": "<mail>" if "@" in m[0] else "<number>"} for m in REDACTED.finditer(text)]


def redacted_counts(docs: DataFrame, ranks_file: str = RANKS_FILE) -> DataFrame:
    """Counts of each row of ``docs`` before and after its redaction."""
    return apply_edits(build_trees(docs, ranks_file, edits_of=redactions), ranks_file)
