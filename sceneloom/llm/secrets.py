"""Secret scans: fixed patterns, and strings that compress badly where secrets stand.

A candidate is a run of key characters close after a sensitive word. Its
novelty is what it adds to the compressed size of the code around it, with a
zstandard dictionary of identifiers primed: a name seen around or elsewhere
costs little, a key costs nearly its length. Strings of a key's shape are kept
out of what primes, so that copies of a key don't hide it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In the order of the report.
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]{16,}"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
}
LEAST_ASSIGNED = 6
#: One of these, in lower case, is in any text that "assign" matches.
ASSIGN_WORDS = ("passw", "secret", "token", "api_key", "apikey")
SENSITIVE = re.compile(r"passw|pwd|secret|token|api[ _-]?key|credential|bearer|authorization|private[ _-]?key|access[ _-]?key", re.IGNORECASE | re.ASCII)
SENSITIVE_WORDS = ("passw", "pwd", "secret", "token", "api", "credential", "bearer", "authorization", "private", "access")
LEAST_NOVEL = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST_NOVEL},}}")
_LEADING = re.compile(r"[=.\-/+_]*")
_PIECE = re.compile(rf"[A-Za-z0-9]{{{LEAST_NOVEL},}}")
_WORD = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}")
_NOT_WORD = re.compile(r"[^aeiouy]+|.*[^aeiouy]{5}.*", re.IGNORECASE)
#: A name has fewer runs of digits.
KEY_DIGITS = 3
#: The share of a string's letters and digits that stand in words from which it is a name and may prime.
NAME_SHARE = 0.6
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,30}")
#: A candidate starts within so many characters of the sensitive word's end.
REACH = 80
#: Characters of context on each side.
AROUND = 256
#: Identifiers in the dictionary, the most frequent ones near sensitive words.
DICTIONARY_WORDS = 2_000
#: Compressed bytes for each byte of a candidate from which it is reported.
NOVELTY = 0.72


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and not overlapping within a kind."""
    low = text.lower()
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), "assign", m.end()) for m in PATTERNS["assign"].finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in PATTERNS["access"].finditer(text)]
    out += [(m.start(), "hex", m.end()) for m in PATTERNS["hex"].finditer(text)]
    return out


def sensitive_ends(text: str) -> list[int]:
    low = text.lower()
    return [m.end() for m in SENSITIVE.finditer(text)] if any(w in low for w in SENSITIVE_WORDS) else []


def fits(value: str) -> bool:
    """Whether a string has a candidate's length and two kinds of characters."""
    return len(value) >= LEAST_NOVEL and sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]")) >= 2


def like_key(value: str) -> bool:
    """Whether a string fits a candidate's shape and isn't made of words (letters of one case, after a capital or not, with vowels)."""
    words = sum(len(w) for w in _WORD.findall(value) if not _NOT_WORD.fullmatch(w))
    return fits(value) and (words < NAME_SHARE * sum(c.isalnum() for c in value) or len(re.findall("[0-9]+", value)) >= KEY_DIGITS)


def blanked(text: str) -> str:
    """The text, as long as before, with spaces for strings like keys."""
    blank = lambda m: " " * len(m[0]) if like_key(m[0]) else m[0]
    return CANDIDATE.sub(lambda m: _PIECE.sub(blank, blank(m)), text)


def joined_spans(spans: list[tuple[int, str, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of spans that don't touch, in order, which cover the same."""
    starts, ends = [], []
    for s, _, e in sorted(spans):
        if starts and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def novel_spans(text: str, taken: list[tuple[int, str, int]], novelty) -> list[tuple[int, str, int]]:
    """Candidates after sensitive words, apart from spans that are already taken, of enough novelty.

    What is taken is looked up in order, a run of candidate characters is followed
    to its end once, and only the context of a candidate is copied.
    """
    starts, ends = joined_spans(taken)
    out, seen, plain, run_start, run_end = [], set(), None, 0, 0
    for end in sensitive_ends(text):
        for m in CANDIDATE.finditer(text, end, end + REACH + 4 * AROUND):
            if m.start() > end + REACH:
                break
            if not run_start <= m.start() < run_end:
                run_start = m.start()
                run_end = CANDIDATE.match(text, m.start()).end()
            s, e = _LEADING.match(text, m.start(), run_end).end(), run_end
            # Right after the word, with nothing between, it is a longer name.
            if s == end or s in seen or e - s < LEAST_NOVEL:
                continue
            k = bisect_left(starts, e) - 1
            if k >= 0 and ends[k] > s:
                continue
            value = text[s:e]
            if not fits(value):
                continue
            seen.add(s)
            plain = blanked(text) if plain is None else plain
            # An occurrence of the value may stand across the context's border.
            before, after = plain[max(0, s - AROUND - len(value)) : s], plain[e : e + AROUND + len(value)]
            if like_key(value):
                before, after = (x.replace(value, " " * len(value)) for x in (before, after))
            if novelty(before[-AROUND:], value, after[:AROUND]) >= NOVELTY:
                out.append((s, "novel", e))
    return out


class Novelty:
    """Marginal compressed bytes for each byte of a candidate."""

    def __init__(self, dictionary: bytes):
        primed = {}
        if len(dictionary) >= 8:
            primed = {"dict_data": zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)}
        self.size = lambda data, c=zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False, **primed): len(c.compress(data))

    def __call__(self, before: str, candidate: str, after: str) -> float:
        around = (before + after).encode("utf-8", "surrogatepass")
        own = candidate.encode()
        return (self.size(around + b"\n" + own) - self.size(around + b"\n")) / len(own)


def identifier_dictionary(docs: DataFrame, words: int = DICTIONARY_WORDS) -> bytes:
    """The ``words`` identifiers around sensitive words in the most different texts, the most frequent last. A bounded size by its parameter.

    Strings like keys, and what stands in them, are left out.
    """

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for text, number in zip(rows["text"], rows["number"], strict=True):
                found, upto = set(), 0
                ends = sensitive_ends(text)
                plain = blanked(text) if ends else text
                for end in ends:
                    start = max(upto, end - AROUND)
                    upto = max(upto, min(len(text), end + AROUND))
                    found.update(IDENTIFIER.findall(plain, start, upto))
                if found:
                    yield pd.DataFrame({"word": list(found), "number": number})

    low = F.lower("text")
    likely = docs.select("text", F.xxhash64("text").alias("number")).filter(reduce(lambda a, b: a | b, [low.contains(w) for w in SENSITIVE_WORDS]))
    # Each text counts once, however often it and the identifier in it repeat.
    counts = likely.mapInPandas(near, "word string, number long").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    top = [r.word for r in counts.orderBy(F.desc("n"), "word").limit(words).collect()]
    return " ".join(reversed(top)).encode()


def scan(docs: DataFrame, dictionary: bytes | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256 and spans for each row of ``docs``.

    Spans are kind:start:end in code points, end exclusive, by start and then
    in the order assign, access, hex, novel. A null text is empty: no spans,
    the hash of an empty string. Repeated rows are scanned each; an empty
    table gives no rows.
    """
    primed = identifier_dictionary(docs) if dictionary is None else dictionary

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        novelty, kinds = Novelty(primed), [*PATTERNS, "novel"]
        joined = lambda spans: ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], kinds.index(x[1]))))
        for rows in batches:
            out = []
            for text in rows["text"]:
                base = base_spans(text)
                novel = novel_spans(text, base, novelty)
                n = [sum(k == kind for _, k, _ in base) for kind in PATTERNS]
                out.append((*n, len(novel), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + novel)))
            got = pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])
            yield pd.concat([rows["doc_id"].astype("Int64").reset_index(drop=True), got], axis=1)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")
