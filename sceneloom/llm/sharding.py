"""Shards cut from a Hilbert curve over several metadata columns.

Each column is quantised to 16 steps at its own quantiles, the steps of a row
give a cell, and the cell's place on the Hilbert curve orders the rows. Rows
near on the curve are near in every column, so a file cut from a run of the
curve spans a narrow range of each and can be skipped on any of them. All of
it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, numbered, summed_before, with_row_ids

SHARDS = 40
BITS = 4
DIMENSIONS = ("lang", "source", "size")
ROW_BYTES = 16
#: Distinct values of a column whose steps may be broadcast; beyond, the join shuffles.
BROADCAST_VALUES = 50_000
#: Sizes are quantised by octaves cut in 32.
PER_OCTAVE = 32


def hilbert_index(steps: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a cell, whose steps are ints in [0, 2**bits).

    Axes are folded bit by bit from the highest: a set bit mirrors the lower
    bits of the first axis, an unset one swaps them with it. What is left,
    Gray-coded and interleaved, counts along the curve.
    """
    n = len(steps)
    put = lambda xs, i, v: F.transform(xs, lambda x, j: F.when(j == i, v).otherwise(x))
    xor = lambda a, b: a.bitwiseXOR(b)
    xs = F.array(*[s.cast("int") for s in steps])

    def fold(q: int, i: int):
        def step(xs: Column) -> Column:
            first, own, low = xs[0], xs[i], F.lit(q - 1)
            swap = xor(first, own).bitwiseAND(low)
            is_set = own.bitwiseAND(F.lit(q)) > 0
            if i == 0:
                return put(xs, 0, F.when(is_set, xor(first, low)).otherwise(first))
            new_first = F.when(is_set, xor(first, low)).otherwise(xor(first, swap))
            return put(put(xs, 0, new_first), i, F.when(is_set, own).otherwise(xor(own, swap)))

        return step

    # Each step takes the one before through a one-element array, so that nothing is worked out twice.
    then = lambda xs, f: F.transform(F.array(xs), f)[0]
    for b in range(bits - 1, 0, -1):
        for i in range(n):
            xs = then(xs, fold(1 << b, i))
    gray = lambda i: lambda v: put(v, i, xor(v[i], v[i - 1]))
    for i in range(1, n):
        xs = then(xs, gray(i))

    def undo(v: Column) -> Column:
        t = F.lit(0)
        for b in range(bits - 1, 0, -1):
            t = xor(t, F.when(v[n - 1].bitwiseAND(F.lit(1 << b)) > 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
        return F.transform(v, lambda x: xor(x, t))

    def interleave(v: Column) -> Column:
        out = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                out = F.shiftleft(out, 1) + F.shiftright(v[i], b).bitwiseAND(F.lit(1))
        return out

    return then(then(xs, undo), interleave)


def quantised(cells: DataFrame, rows: DataFrame, dimension: str, bits: int, scratch: Scratch) -> DataFrame:
    """``cells`` with ``dimension`` replaced by its step: the share of all rows with a lesser value, in 2**bits parts.

    Equal values share a step, nulls come first. Values are counted over all
    rows; the counts decide, so reruns agree.
    """
    values = rows.groupBy(dimension).agg(F.count(F.lit(1)).alias("__n"))
    before = summed_before(values, [dimension], "__n", scratch, f"values_{dimension}", "__before")
    total = F.lit(max(rows.count(), 1))
    steps = before.select(F.col(dimension).alias("__value"), F.expr(f"__before << {bits}").alias("__before"))
    steps = steps.select("__value", F.floor(F.col("__before") / total).cast("int").alias("__step"))
    if values.count() <= BROADCAST_VALUES:
        steps = F.broadcast(steps)
    return cells.join(steps, cells[dimension].eqNullSafe(steps["__value"])).drop(dimension, "__value").withColumnRenamed("__step", dimension)


def hilbert_shards(docs: DataFrame, scratch: Scratch, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row, and its columns ``carry``, which should be narrow.

    Shards are runs of the curve; their row counts are at most one apart.
    ``slot`` is the row's place in its shard. Rows of equal text stand
    together: all take the curve place of the group's least metadata, and the
    text's hashes order rows within a place. Null texts have size 16 and count
    as an empty text; null metadata take step 0. Rows that repeat take
    neighbouring places; of an empty table nothing comes back.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + ROW_BYTES
    group = [F.xxhash64(text).alias("__a"), F.crc32(text.cast("binary")).alias("text_crc32")]
    dims = [(F.floor(F.log2(size) * PER_OCTAVE).cast("int") if c == "size" else F.col(c)).alias(f"__d{k}") for k, c in enumerate(dimensions)]
    names = [f"__d{k}" for k in range(len(dims))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), *group, *dims, *carry)
    rows = scratch.keep(rows, "rows")
    key = ["__a", "text_crc32", "size"]
    cells = scratch.keep(rows.groupBy(*key).agg(*[F.min(n).alias(n) for n in names]), "groups")
    for n in names:
        cells = quantised(cells, rows, n, bits, scratch)
    cells = cells.select(*key, hilbert_index([F.col(n) for n in names], bits).alias("__h"))
    placed = rows.drop(*names).join(cells, key)
    order = ["__h", *key, "doc_id"]
    ranked = numbered(placed, order, scratch, "ranked", "__rank")
    total = rows.count()
    # rank is in run s from ceil(s * total / shards) on: long arithmetic only.
    shard = F.expr(f"(__rank * {shards}L) DIV {max(total, 1)}L")
    start = F.expr(f"(__shard * {max(total, 1)}L + {shards - 1}L) DIV {shards}L")
    out = ranked.withColumn("__shard", shard).withColumn("__slot", F.col("__rank") - start)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("__shard").cast("int").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *carry)


def sharded_documents(docs: DataFrame, scratch: Scratch, shards: int = SHARDS, **options) -> DataFrame:
    """The rows of ``docs`` with all their columns, ``shard`` and ``slot``; a ``shard`` or ``slot`` of their own goes.

    Partitions are runs of shard and slot in order, so files are too, and a
    large shard takes several.
    """
    rows = with_row_ids(docs, scratch)
    places = hilbert_shards(rows, scratch, shards, carry=("__rid",), **options).select("__rid", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    parts = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = rows.join(places, "__rid").repartitionByRange(parts, "__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    return out.select(*own, F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))

