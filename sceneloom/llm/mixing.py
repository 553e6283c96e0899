"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, n_words_of, numbered, summed_before, with_row_ids

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Words in a block. A source's words come to its target but for half a block and the last, shorter one.
BLOCK = 16
SEED = "mix-1"
SHARDS = 40


def source_targets(sources: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``sources`` (source, source_size) with ``place``, ``weight`` and ``target``.

    Sources by code point, null last, take the weights in turn and share the
    words of all. A target stops at ``most`` times the source's size; what is
    over is shared by weight among the others until none is above.
    """
    rows = numbered(sources.withColumn("__null", F.col("source").isNull()), ["__null", "source"], scratch, "places", "place").drop("__null")
    turn = F.array(*[F.lit(w) for w in weights])
    rows = scratch.keep(rows.withColumn("weight", F.get(turn, F.pmod("place", F.lit(len(weights))).cast("int")).cast("long")).withColumn("__cap", most * F.col("source_size")), "weighted")
    total, of_all = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    big = lambda c: F.col(c).cast("decimal(19,0)")
    rest, shared = total, of_all
    while True:
        above = big("__cap") * F.lit(shared).cast("decimal(19,0)") < big("weight") * F.lit(rest).cast("decimal(19,0)")
        held, left = rows.agg(F.coalesce(F.sum(F.when(above, F.col("__cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if (total - held, left) == (rest, shared):
            break
        rest, shared = total - held, left
    target = F.when(above, F.col("__cap").cast("double")).otherwise((F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(max(shared, 1))))
    return rows.withColumn("target", target).drop("__cap")


def seats_at(targets: DataFrame, houses: list[int]) -> DataFrame:
    """(place, house, seats) for each of several numbers of blocks: seats dealt one by one to the highest target / (2 * seats so far + 1); ties to the lower place.

    Dividing by the mean and rounding misses by half a seat for each source
    at most; only the quotients around that are ranked, a few for each source
    and house. ``house`` is the place in ``houses``.
    """
    total, n = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count(F.lit(1))).first()
    each = targets.select("place", "target", F.posexplode(F.array(*[F.lit(h).cast("long") for h in houses])).alias("house", "blocks"))
    if not total:
        return each.select("place", "house", F.lit(0).cast("long").alias("seats"))
    near = each.withColumn("seats", F.floor(F.col("target") * F.col("blocks") / total + 0.5).cast("long"))
    # A row for each house.
    short = near.groupBy("house").agg((F.first("blocks") - F.sum("seats")).alias("short"))
    near = near.join(F.broadcast(short), "house")
    # One source gains or loses no more than its share of what is short and of one seat a source.
    reach = F.floor(F.col("target") * (F.abs("short") + n) / total).cast("long") + 2
    more, fewer = F.sequence(F.col("seats"), F.col("seats") + reach), F.sequence(F.greatest(F.col("seats") - reach, F.lit(0)), F.greatest(F.col("seats") - 1, F.lit(0)))
    asked = near.filter("short > 0 AND target > 0 OR short < 0 AND seats > 0")
    quotients = asked.select("place", "house", "short", F.explode(F.when(F.col("short") > 0, more).otherwise(fewer)).alias("k"), "target")
    sign = F.signum("short")
    by = W.partitionBy("house").orderBy(F.desc(sign * F.col("target") / (2 * F.col("k") + 1)), F.asc(sign * F.col("place")))
    changed = quotients.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= F.abs("short")).groupBy("place", "house").agg(F.count(F.lit(1)).alias("c"))
    return near.join(changed, ["place", "house"], "left").select("place", "house", (F.col("seats") + F.signum("short").cast("long") * F.coalesce("c", F.lit(0))).alias("seats"))


def shard_quotas(targets: DataFrame, blocks: int, shards: int = SHARDS) -> DataFrame:
    """(place, upto, quotas): the blocks of each source in each of ``shards`` equal shards, and their running sum.

    Seats never shrink as their number grows, so a shard's quotas are what
    its blocks add to the seats of the shards before it. All shards' seats
    are found in one job.
    """
    rows = seats_at(targets, [blocks * (s + 1) // shards for s in range(shards)])
    listed = rows.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("house", "seats")))["seats"].alias("upto"))
    return listed.withColumn("quotas", F.transform("upto", lambda u, s: u - F.when(s > 0, F.get("upto", s - 1)).otherwise(0)))


def _seeded(seed: str, what: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(what.cast("string"), F.lit("-"))))


def quotas_of(sources: DataFrame, scratch: Scratch, weights: tuple[int, ...], most: int, block: int, seed: str, shards: int) -> DataFrame:
    """``sources`` (source, source_size and more) with ``target``, the running quotas of the shards and what a row of blocks is dealt by."""
    targets = scratch.keep(source_targets(sources, scratch, weights, most), "targets")
    total = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    quotas = targets.join(shard_quotas(targets, -(-total // block), shards), "place")
    quotas = quotas.withColumn("__n", F.greatest(F.ceil(F.col("source_size") / block), F.lit(1)).cast("long"))
    quotas = quotas.withColumn("__q", F.least(F.element_at("upto", -1), most * F.col("__n")))
    offset = F.pmod(F.conv(F.substring(_seeded(seed, F.col("source")), 1, 12), 16, 10).cast("long"), F.col("__n"))
    quotas = quotas.select(*sources.columns, "target", F.col("upto").alias("__upto"), "__n", "__q", F.expr("__q DIV __n").alias("__base"), F.expr("__q % __n").alias("__rest"), offset.alias("__offset"))
    return scratch.keep(quotas, "quotas")


def _with_quotas(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """A hot source is split where it meets its quota: the join may deal its rows to many tasks."""
    few = F.broadcast(quotas) if quotas.count() <= BROADCAST_SOURCES else quotas
    return rows.join(few, rows["source"].eqNullSafe(quotas["source"])).drop(quotas["source"])


def _dealt(j: str) -> str:
    """Blocks dealt once more before block ``j``: spread evenly from the offset."""
    return f"((cast({j} AS decimal(19,0)) * cast(__rest AS decimal(19,0)) + __offset) DIV __n)"


def mix(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, block: int = BLOCK, seed: str = SEED, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, first_shard and last_shard for each row of ``docs``.

    The words of a source stand in a row, its documents in seeded order, cut
    in blocks. Its quotas in all shards make q blocks: each of its n blocks
    is picked q DIV n times and q MOD n of them once more, spread evenly from
    a seeded offset. The picks, in the order of the blocks, fill the quotas of
    the shards one after another. ``taken`` counts a document's words in
    picked blocks, repeats included, at most ``most`` times its size; its
    picks go to the shards from ``first_shard`` to ``last_shard``, null
    without any. Null and blank texts have size 0 and nothing taken; null
    sources are one source, the last; rows that repeat count each; an empty
    table gives no rows. Reruns agree.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words_of(F.col("text")).alias("size"), _seeded(seed, F.col("doc_id")).alias("__key"))
    placed = scratch.keep(summed_before(rows, ["source", "__key", "size"], "size", scratch, "ordered", "__before"), "placed")
    sources = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("__before").alias("__start"))
    rows = _with_quotas(placed, quotas_of(sources, scratch, weights, most, block, seed, shards))
    upto = lambda w: F.expr(f"__base * ({w}) + {block} * {_dealt(f'(({w}) DIV {block})')} + ({_dealt(f'(({w}) DIV {block} + 1)')} - {_dealt(f'(({w}) DIV {block})')}) * (({w}) % {block})")
    rows = rows.withColumn("__at", F.col("__before") - F.col("__start"))
    taken = (upto("__at + size") - upto("__at")).cast("long")
    picks = lambda j: F.expr(f"cast(__base * ({j}) + {_dealt(j)} AS long)")
    rows = rows.withColumns({"taken": taken, "__first": picks(f"(__at DIV {block})"), "__last": picks(f"((__at + size + {block - 1}) DIV {block})") - 1})
    shard = lambda p: F.when(F.col("taken") > 0, F.size(F.filter("__upto", lambda u: u <= F.col(p))))
    return rows.select("doc_id", "size", "source", "source_size", "target", "taken", shard("__first").alias("first_shard"), shard("__last").alias("last_shard"))


def mixed_documents(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, block: int = BLOCK, seed: str = SEED, shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, whole, with all their columns.

    A source with q blocks of quotas and n blocks of words takes each of its
    documents q DIV n times or once more: along its documents by size, from a
    seeded offset, the takes keep step with q / n. So its words come to its
    target but for less than twice its largest document. Rows without words
    are left out.
    """
    rows = with_row_ids(docs, scratch)
    sized = rows.select("__rid", F.col("source").cast("string").alias("source"), n_words_of(F.col("text")).alias("size"), _seeded(seed, F.col("doc_id")).alias("__key")).filter("size > 0")
    placed = numbered(sized, ["source", "size", "__key"], scratch, "ordered", "__rank")
    placed = scratch.keep(placed.drop("__key"), "placed")
    sources = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("__rank").alias("__start"))
    taken = _with_quotas(placed, quotas_of(sources, scratch, weights, most, block, seed, shards)).withColumn("__i", F.col("__rank") - F.col("__start"))
    times = F.expr(f"cast(__base + {_dealt('(__i + 1)')} - {_dealt('__i')} AS int)")
    taken = taken.select("__rid", times.alias("__times")).filter("__times > 0")
    return rows.join(taken, "__rid").withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).select(docs.columns)


#: Distinct sources whose quotas may be broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 20_000
