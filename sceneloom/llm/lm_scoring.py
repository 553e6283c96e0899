"""Language-model scores by deleted interpolation of n-gram estimates.

The model mixes maximum-likelihood estimates of orders 1 to ``order`` with a
uniform one. Its mixture weights depend on how often the context was seen
(by powers of two) and are learned by expectation-maximisation on a fold of
the training documents, each held out of the counts by deleting its own.

Documents are packed into chunks of a few million tokens. A chunk sends the
sorted, distinct hashes of its n-grams to buckets of the hash space, a row of
packed numbers for each bucket; a bucket sums the training counts and sends
each chunk the totals of its own n-grams. So no task holds more than a chunk
or a bucket, and hot n-grams weigh no more than others: each chunk sends one
of a kind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

ORDER = 2
FOLDS, HELD_OUT = 7, 2
#: The training fold on which the weights are learned.
WEIGHED = 3
#: Kinds of documents: trained on, trained on and weighed, scored only.
TRAIN, WEIGH, SCORE = 0, 1, 2
CHUNK_TOKENS = 2_000_000
#: N-grams that one bucket holds, about, before they are merged.
BUCKET_KEYS = 1_000_000
#: Bins for each power of two of a probability, in the histogram that the weights are learned from.
BINS = 8
LEAST_WEIGHT = 1e-6
ROUNDS = 200

_CHUNK = "chunk long, kind int, doc_ids array<long>, lengths array<long>, words binary, ids binary"
_KEYS = "gram int, bucket int, chunk long, kind int, width int, keys binary, counts binary"
_TOTALS = "gram int, bucket int, chunk long, kind int, distinct long, totals binary"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _packed(doc_ids: list, texts: list[list[int]], words: _Numbers, kind: int, number: int) -> pd.DataFrame:
    ids = np.concatenate([np.asarray(t, np.uint32) for t in texts])
    row = (number, kind, doc_ids, [len(t) for t in texts], b" ".join(words), ids.tobytes())
    return pd.DataFrame([row], columns=["chunk", "kind", "doc_ids", "lengths", "words", "ids"])


def _chunks(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made = TaskContext.get().partitionId(), 0
        open_: dict[int, tuple[list, list, _Numbers, list[int]]] = {}
        for rows in batches:
            for doc_id, kind, text in zip(rows["doc_id"], rows["kind"], rows["text"], strict=True):
                if kind not in open_:
                    # Word 0 is the end of a text; no word is empty.
                    open_[kind] = ([], [], _Numbers({b"": 0}), [0])
                ids, texts, words, tokens = open_[kind]
                numbers = [words[w] for w in text.encode("utf-8", "surrogatepass").lower().split()]
                numbers.append(0)
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                texts.append(numbers)
                tokens[0] += len(numbers)
                if tokens[0] >= most:
                    yield _packed(ids, texts, words, int(kind), (part << 32) + made)
                    del open_[kind]
                    made += 1
        for kind, (ids, texts, words, _) in open_.items():
            yield _packed(ids, texts, words, int(kind), (part << 32) + made)
            made += 1

    return run


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _gram_hashes(words: bytes, ids: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """For orders 1 to ``order`` the hash of the n-gram that ends at each token; a text is preceded by starts."""
    of_word = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.split(b" ")), np.uint64)
    one = of_word[ids]
    first = np.zeros(len(ids), bool)
    first[np.cumsum(lengths)[:-1]] = True
    first[:1] = True
    out, place = [one], np.arange(len(ids)) - np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
    for k in range(1, order):
        # The word k back, or a start.
        back = np.concatenate([np.zeros(k, np.uint64), one[:-k]])
        back[place < k] = np.uint64(0x5851F42D4C957F2D)
        out.append(_mixed(out[-1] * np.uint64(0x9E3779B97F4A7C15) + _mixed(back + np.uint64(k))))
    return out


def _narrow(values: np.ndarray) -> np.ndarray:
    top = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def _put_keys(keys: np.ndarray) -> tuple[int, bytes]:
    """Sorted keys as differences, in as many bytes as the largest one needs."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return width, steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _get_keys(width: int, data: bytes) -> np.ndarray:
    octets = np.frombuffer(data, np.uint8).reshape(-1, width)
    steps = np.zeros((len(octets), 8), np.uint8)
    steps[:, :width] = octets
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _unpack(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(bytes(row.ids), np.uint32), np.asarray(row.lengths, np.int64)


def _keys(order: int, bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples():
                ids, lengths = _unpack(row)
                for gram, hashes in enumerate(_gram_hashes(bytes(row.words), ids, lengths, order), 1):
                    keys, counts = np.unique(hashes, return_counts=True)
                    cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
                    out = []
                    for b in np.flatnonzero(np.diff(cuts)):
                        part = slice(cuts[b], cuts[b + 1])
                        out.append((gram, int(b), row.chunk, row.kind, *_put_keys(keys[part]), b"" if row.kind == SCORE else _narrow(counts[part]).tobytes()))
                    yield pd.DataFrame(out, columns=["gram", "bucket", "chunk", "kind", "width", "keys", "counts"])

    return run


def _sum_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    each = [_get_keys(w, bytes(k)) for w, k in zip(rows["width"], rows["keys"], strict=True)]
    sizes = [len(k) for k in each]
    added = [np.zeros(n, np.int64) if not len(c) else np.frombuffer(bytes(c), f"<u{len(c) // n}").astype(np.int64) for c, n in zip(rows["counts"], sizes, strict=True)]
    keys, back = np.unique(np.concatenate(each), return_inverse=True)
    # bincount sums in doubles: whole numbers up to 2**53 stay whole.
    sums = np.bincount(back, np.concatenate(added), len(keys)).astype(np.uint64)
    ends = np.cumsum(sizes)
    out = rows[["gram", "bucket", "chunk", "kind"]].copy()
    out["distinct"] = 0
    out.iloc[0, out.columns.get_loc("distinct")] = int((sums > 0).sum())
    out["totals"] = [_narrow(sums[back[e - n : e]]).tobytes() for n, e in zip(sizes, ends, strict=True)]
    return out


def _per_token(row, order: int, bits: int, train_docs: int, deleted: bool = False) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order the training count of the n-gram and of its context, at each token; where texts start.

    ``deleted`` leaves what a text itself added out of its counts.
    """
    ids, lengths = _unpack(row)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    got: dict[int, list] = {k: [] for k in range(1, order + 1)}
    for t in row.totals:
        got[t["gram"]].append((t["bucket"], bytes(t["totals"])))
    counts, contexts = [], []
    for gram, hashes in enumerate(_gram_hashes(bytes(row.words), ids, lengths, order), 1):
        keys, back = np.unique(hashes, return_inverse=True)
        cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
        parts = [np.frombuffer(data, f"<u{len(data) // int(cuts[b + 1] - cuts[b])}").astype(np.int64) for b, data in sorted(got[gram])]
        counts.append(np.concatenate(parts)[back])
        if deleted:
            _, same, own = np.unique(np.repeat(np.arange(len(lengths)), lengths) * len(keys) + back, return_inverse=True, return_counts=True)
            counts[-1] = counts[-1] - own[same]
        if gram > 1:
            context = np.concatenate([[0], counts[gram - 2][:-1]])
            context[starts] = train_docs - deleted
            contexts.append(context)
    return counts, contexts, starts


def _estimates(counts, contexts, tokens: int | np.ndarray, distinct: int) -> list[np.ndarray]:
    uniform = np.full(len(counts[0]), 1.0 / (distinct + 1))
    return [uniform, counts[0] / np.maximum(tokens, 1), *[c / np.maximum(x, 1) for c, x in zip(counts[1:], contexts, strict=True)]]


def _level(counts, contexts) -> np.ndarray:
    """The context's bucket: how many binary digits its count has."""
    seen = contexts[-1] if contexts else np.zeros(len(counts[0]), np.int64)
    return np.frexp(seen.astype(np.float64))[1].astype(np.int64)


def _histogram(order: int, bits: int, train: tuple[int, int, int]):
    docs, tokens, distinct = train

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples():
                counts, contexts, _ = _per_token(row, order, bits, docs, deleted=True)
                lengths = np.asarray(row.lengths, np.int64)
                estimates = _estimates(counts, contexts, tokens - np.repeat(lengths, lengths), distinct)[1:]
                bins = [np.where(p > 0, np.round(-np.log2(np.maximum(p, 1e-300)) * BINS), -1).astype(np.int64) for p in estimates]
                cells, n = np.unique(np.stack([_level(counts, contexts), *bins]), axis=1, return_counts=True)
                yield pd.DataFrame({"level": cells[0], "bins": list(cells[1:].T), "n": n})

    return run


def _learn(order: int, distinct: int):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        bins = np.stack(cells["bins"].to_list()).astype(np.float64)
        p = np.concatenate([np.full((len(cells), 1), 1.0 / (distinct + 1)), np.where(bins < 0, 0.0, np.exp2(-np.maximum(bins, 0) / BINS))], 1)
        n, weights = cells["n"].to_numpy(np.float64), np.full(order + 1, 1.0 / (order + 1))
        for _ in range(ROUNDS):
            share = p * weights
            share /= share.sum(1, keepdims=True)
            new = (share * n[:, None]).sum(0) / n.sum()
            done, weights = np.abs(new - weights).max() < 1e-7, new
            if done:
                break
        return pd.DataFrame({"level": [cells["level"].iloc[0]], "weights": [weights]})

    return run


def _score(order: int, bits: int, train: tuple[int, int, int], table: np.ndarray):
    docs, tokens, distinct = train

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples():
                counts, contexts, starts = _per_token(row, order, bits, docs)
                weights = table[np.minimum(_level(counts, contexts), len(table) - 1)]
                p = sum(weights[:, k] * e for k, e in enumerate(_estimates(counts, contexts, tokens, distinct)))
                base = np.log10((counts[0] + 1) / (tokens + distinct + 1))
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(row.doc_ids, "Int64"),
                        "held_out": row.kind == SCORE,
                        "n_tokens": np.asarray(row.lengths, np.int64),
                        "n_known": np.add.reduceat((counts[0] > 0).astype(np.int64), starts),
                        "train_tokens": tokens,
                        "base_score": np.add.reduceat(base, starts),
                        "score": np.add.reduceat(np.log10(p), starts),
                    }
                )

    return run


def weight_table(learned: list, order: int) -> np.ndarray:
    """Weights by level 0 to 63. Levels that no weighed token has take those of all (level -1), or equal ones.

    Each weight is at least about LEAST_WEIGHT, so that no text is impossible.
    """
    by = {r["level"]: np.array(r["weights"], np.float64) for r in learned}
    rest = by.get(-1, np.full(order + 1, 1.0 / (order + 1)))
    table = np.stack([by.get(k, rest) for k in range(64)]) + LEAST_WEIGHT
    return table / table.sum(1, keepdims=True)


def score_documents(docs: DataFrame, scratch: Scratch, order: int = ORDER, held: Callable | None = None, chunk_tokens: int = CHUNK_TOKENS, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs``.

    ``held`` gives the boolean column of rows that don't train; the default
    takes crc32 of the id as text, modulo 7, equal to 2. Of those that train
    the fold 3 gives the mixture weights; without any the weights are equal.
    Rows that don't train change no other row's score. Null and empty texts
    are one token, the end; a null id counts as an empty text and trains.
    Repeated rows train and are scored each. Without training rows every
    estimate but the uniform one is 0; an empty table gives no rows.
    N-grams are told apart by 64-bit hashes.
    """
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    fold = F.crc32(number.cast("binary")) % FOLDS
    kind = F.when(held(docs) if held else fold == HELD_OUT, SCORE).when(fold == WEIGHED, WEIGH).otherwise(TRAIN)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = scratch.keep(rows.mapInPandas(_chunks(chunk_tokens), _CHUNK), "chunks")
    length = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    train_docs, tokens, all_tokens = chunks.agg(F.sum(F.when(F.col("kind") < SCORE, F.size("lengths"))), F.sum(F.when(F.col("kind") < SCORE, length)), F.sum(length)).first()
    train_docs, tokens = train_docs or 0, tokens or 0
    bits = max(6, (order * (all_tokens or 0) // bucket_keys).bit_length())
    keys = chunks.mapInPandas(_keys(order, bits), _KEYS)
    totals = scratch.keep(keys.groupBy("gram", "bucket").applyInPandas(_sum_bucket, _TOTALS), "totals")
    distinct = totals.filter("gram = 1").agg(F.sum("distinct")).first()[0] or 0
    train = (train_docs, tokens, distinct)

    def answered(chunks: DataFrame, totals: DataFrame) -> DataFrame:
        mine = totals.groupBy("chunk").agg(F.collect_list(F.struct("gram", "bucket", "totals")).alias("totals"))
        return chunks.join(mine, "chunk")

    cells = answered(chunks.filter(F.col("kind") == WEIGH), totals.filter(F.col("kind") == WEIGH)).mapInPandas(_histogram(order, bits, train), "level long, bins array<long>, n long")
    cells = scratch.keep(cells.groupBy("level", "bins").agg(F.sum("n").alias("n")), "cells")
    pooled = cells.groupBy("bins").agg(F.sum("n").alias("n")).select(F.lit(-1).cast("long").alias("level"), "bins", "n")
    # At most 65 rows: one for each binary length of a count, and one for all.
    learned = cells.unionByName(pooled).groupBy("level").applyInPandas(_learn(order, distinct), "level long, weights array<double>").collect()
    scored = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answered(chunks, totals).mapInPandas(_score(order, bits, train, weight_table(learned, order)), scored)
