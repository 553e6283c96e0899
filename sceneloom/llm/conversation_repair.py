"""Conversation structure repair by dynamic programming shared along a prefix trie.

A conversation is told by a signature, one letter for each row: its role and
fault. Signatures are sorted and inserted into a trie in that order, so that
the nodes above the last terminal are the ones that the next signature can
share; each node's layer of the program is worked out once, when it is
inserted, and answers are read off at terminal nodes. Repaired role initials
are ``(s?(ua)+)?``: empty, or a system turn if there is one and then pairs of
user and assistant.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: What has been written: nothing, a system turn, a user turn last, an assistant turn last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: State after each role that may follow.
FOLLOWS = {EMPTY: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The role that an inserted or re-roled turn has: the grammar leaves one.
NEXT = {EMPTY: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
#: Inserted turns before a row, or at the end, that can pay: more come back to a state at a cost.
MOST_INSERTED = 2


def _inserted(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, audit) after 0, 1, ... inserted turns."""
    out = [(state, 0, "")]
    for _ in range(MOST_INSERTED):
        state, cost, audit = out[-1]
        out.append((FOLLOWS[state][NEXT[state]], cost + INSERT, audit + "I"))
    return out


def _steps(letter: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit) of the cheapest way over a row between each two states; of equal costs the least audit.

    Letters: s, u, a or x (any other role) of a whole row, the same in upper
    case of a truncated one, d of a row that must go.
    """
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for state in FOLLOWS:
        for at, cost, audit in _inserted(state):
            ways = [(at, cost + DELETE, audit + "D")]
            if letter != "d":
                more = TRUNCATED if letter.isupper() else 0
                ways.append((FOLLOWS[at][NEXT[at]], cost + REROLE + more, audit + "R"))
                if letter.lower() in FOLLOWS[at]:
                    ways.append((FOLLOWS[at][letter.lower()], cost + KEEP + more, audit + "K"))
            for to, c, a in ways:
                best[state, to] = min(best.get((state, to), (c, a)), (c, a))
    return [(a, b, *v) for (a, b), v in best.items()]


STEPS = {letter: _steps(letter) for letter in "suaxSUAXd"}
#: (cost, audit) that end what is written in each state.
ENDS = {state: min((c, a) for at, c, a in _inserted(state) if at in (EMPTY, ASSISTANT)) for state in FOLLOWS}


class Trie:
    """The path of a prefix trie to its last terminal, with a layer at each node.

    A layer has for each state that can be reached (cost, rank, state
    before, audit of this row): rank orders the layer's audits. Each audit ends with
    the letter of its last row, so none begins another, and what follows
    can't change their order.
    """

    def __init__(self):
        self.path: list[str] = []
        self.layers: list[dict[int, tuple[int, int, int, str]]] = [{EMPTY: (0, 0, -1, "")}]
        self.worked_out = 0

    def insert(self, signature: str) -> tuple[int, str]:
        """The least cost of ``signature``'s repair and its audit. Sorted signatures share what they can."""
        shared, most = 0, min(len(self.path), len(signature))
        while shared < most and self.path[shared] == signature[shared]:
            shared += 1
        del self.path[shared:], self.layers[shared + 1 :]
        for letter in signature[shared:]:
            above, best = self.layers[-1], {}
            for state, to, cost, audit in STEPS[letter]:
                if state in above:
                    way = (above[state][0] + cost, above[state][1], audit, state)
                    best[to] = min(best.get(to, way), way)
            order = {to: k for k, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
            self.path.append(letter)
            self.layers.append({to: (c, order[to], state, audit) for to, (c, _, audit, state) in best.items()})
            self.worked_out += 1
        return self._answer()

    def _answer(self) -> tuple[int, str]:
        cost, _, state = min((c + ENDS[s][0], rank, s) for s, (c, rank, _, _) in self.layers[-1].items())
        parts = [ENDS[state][1]]
        for layer in reversed(self.layers[1:]):
            _, _, before, audit = layer[state]
            parts.append(audit)
            state = before
        return cost, "".join(reversed(parts))


def edits_of(audit: str, signature: str) -> list[tuple[str, int | None, str | None]]:
    """(edit, row, role) of each letter of an audit: the row that it is about, and the role's initial after it, null for the row's own."""
    out, state, row = [], EMPTY, 0
    for edit in audit:
        role = None if edit == "D" else signature[row].lower() if edit == "K" else NEXT[state]
        out.append((edit, None if edit == "I" else row, None if edit == "K" else role))
        state = state if role is None else FOLLOWS[state][role]
        row += edit != "I"
    return out


def shared_repairs(signatures: DataFrame) -> DataFrame:
    """(gid, cost, audit, edits) for each row of ``signatures`` (gid, signature).

    Sampled splitters range-partition the signatures, and each partition is
    sorted and goes through a trie of its own. One that many conversations share
    is split by gid; in each partition it is worked out once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, last, answer = Trie(), None, (0, "", [])
        for rows in batches:
            answers = []
            for signature in rows["signature"]:
                if signature != last:
                    cost, audit = trie.insert(signature)
                    last, answer = signature, (cost, audit, [dict(zip(("edit", "row", "role"), e, strict=True)) for e in edits_of(audit, signature)])
                answers.append(answer)
            yield pd.DataFrame({"gid": rows["gid"], "cost": [a[0] for a in answers], "audit": [a[1] for a in answers], "edits": [a[2] for a in answers]})

    parts = int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = signatures.select("gid", "signature").repartitionByRange(parts, "signature", "gid").sortWithinPartitions("signature", "gid")
    return ranged.mapInPandas(run, "gid long, cost long, audit string, edits array<struct<edit:string,row:int,role:string>>")


def _letter(role: Column, must_go: Column, truncated: Column) -> Column:
    initial = F.substring(role, 1, 1)
    plain = F.when(initial.isin(*ROLES), initial).otherwise("x")
    return F.when(must_go, "d").when(truncated, F.upper(plain)).otherwise(plain)


def repaired(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, edits and ``turns`` (array of role, text) for each conversation.

    ``rows``: conv_id, turn, role, text, and ``there`` (false: the
    conversation is named, but the row is gone); ``place`` orders rows of one turn. Null
    roles and texts count as one space; a null turn comes first; a null conv_id is a
    conversation. Rows that repeat are duplicates of the first. A conversation
    without rows has zeros and empty results. ``turns`` is the cheapest
    repair, of equal ones that of the least audit. A conversation's rows come
    together in one row, as its repaired text is one value; there is no other bound on
    them. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), "there", "place")
    ordered = W.partitionBy("conv_id").orderBy(F.col("there").desc(), F.col("turn").asc_nulls_first(), "place")
    rows = rows.withColumns({"at": F.row_number().over(ordered), "_pair": F.concat(F.substring(F.lag("role").over(ordered), 1, 1), F.substring("role", 1, 1))})
    earlier = F.row_number().over(W.partitionBy("conv_id", "there", "role", "text").orderBy("at")) > 1
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    rows = rows.withColumns({"_blank": last == "", "_again": earlier, "_cut": ~last.isin(".", "!", "?")})
    rows = rows.withColumn("letter", _letter(F.col("role"), F.col("_blank") | F.col("_again"), F.col("_cut")))
    count = lambda c: F.count(F.when(F.col("there") & c, 1))
    own = F.when(F.col("there"), F.struct("at", "letter", "turn", "role", "text"))
    grouped = rows.groupBy("conv_id").agg(
        count(F.col("_blank")).alias("blank"),
        count(~F.col("_blank") & F.col("_again")).alias("duplicate"),
        count(~F.col("_blank") & ~F.col("_again") & F.col("_cut")).alias("truncated"),
        count((F.col("at") > 1) & ~F.col("_pair").isin("su", "ua", "au")).alias("illegal"),
        F.array_sort(F.collect_list(own)).alias("rows"),
    )
    turns = F.array_distinct(F.array_compact(F.col("rows.turn")))
    gaps = F.coalesce(F.array_max(turns) - F.array_min(turns) + 1 - F.size(turns), F.lit(0)).cast("long")
    kept = scratch.keep(grouped.select(F.monotonically_increasing_id().alias("gid"), "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.array_join("rows.letter", "").alias("signature"), F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("rows")), "conversations")
    name = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])

    def turn(e: Column) -> Column:
        row = F.get("rows", e["row"])
        return F.struct(F.coalesce(F.element_at(name, e["role"]), row["role"]).alias("role"), F.coalesce(row["text"], F.lit("")).alias("text"))

    answers = kept.join(shared_repairs(kept), "gid")
    fixed = F.transform(F.filter("edits", lambda e: e["edit"] != "D"), turn)
    return answers.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "edits", fixed.alias("turns"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``repaired``'s rows of ``conversations`` (conv_id, turn, role, text) with faults set in by hashes of conversation and turn.

    Of twenty hashes one drops the row, one empties its text, one takes out its full stops, question and
    exclamation marks, one repeats it and one makes it a user's. Rows of one turn
    keep the order of role and text that they had before.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = lambda k: F.col("_hit") == k
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20).alias("_hit"))
    text = F.when(hit(1), "").when(hit(2), F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(hit(3), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    rows = rows.select("conv_id", "turn", "role", "text", "_hit", copies)
    return rows.select("conv_id", "turn", F.when(hit(4), "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (~hit(0)).alias("there"), F.struct("role", "text", "copy").alias("place"))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of ``repaired``'s rows."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("repaired_sha256"))
