"""Conversation repair against a search of all edits, and the contract read once more in plain Python."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from sceneloom.llm import conversation_repair as C

from .helpers import rows_of, scratch

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def plain_repair(rows: list[tuple[str, bool, bool]]) -> tuple[int, str, list]:
    """All ways to edit (initial, must go, truncated) with up to two turns put in at any place; no states, no layers."""
    best = None
    choices = []
    for initial, must_go, cut in rows:
        more = 3 if cut else 0
        choices.append([("D", None, 4)] + ([] if must_go else [("K", initial, more), ("R", "u", 3 + more), ("R", "a", 3 + more)]))
    put_in = [list(itertools.chain.from_iterable(itertools.product("ua", repeat=k) for k in range(3)))] * (len(rows) + 1)
    for picked in itertools.product(*choices):
        for between in itertools.product(*put_in):
            inserted = sum(map(len, between))
            cost = sum(p[2] for p in picked) + 3 * inserted
            if inserted > len(rows) + 1 or best is not None and cost > best[0]:
                continue
            out = [("I", r) for r in between[0]]
            for p, more in zip(picked, between[1:], strict=True):
                out += [p[:2], *(("I", r) for r in more)]
            if GRAMMAR.match("".join(r for _, r in out if r)):
                found = (cost, "".join(e for e, _ in out), [r for _, r in out])
                best = found if best is None else min(best, found, key=lambda f: f[:2])
    return best


@pytest.mark.parametrize("size", [0, 1, 2, 3])
def test_trie_equals_a_search_of_all_edits(size):
    rng = random.Random(size)
    letters = [(c, False, cut) for c in "suax" for cut in (False, True)] + [("d", True, False)]
    cases = list(itertools.product(letters, repeat=size))
    cases = cases if len(cases) <= 81 else rng.sample(cases, 15)
    trie = C.Trie()
    for case in sorted(cases, key=lambda rows: "".join(c.upper() if cut else c for c, _, cut in rows)):
        signature = "".join(c.upper() if cut else c for c, _, cut in case)
        cost, audit = trie.insert(signature)
        want = plain_repair(list(case))
        assert (cost, audit) == want[:2], signature
        roles = [case[row][0] if edit == "K" else role for edit, row, role in C.edits_of(audit, signature)]
        assert roles == want[2], signature


def plain_audit(signature: str) -> tuple[int, str]:
    """Shortest ways over whole audits, cost by cost, for signatures of any length."""
    open_, done = {(0, 0): (0, "")}, []
    for row in range(len(signature) + 1):
        for _ in range(4):  # turns put in
            for (r, state), (cost, audit) in list(open_.items()):
                if r == row:
                    to = (row, C.FOLLOWS[state][C.NEXT[state]])
                    open_[to] = min(open_.get(to, (cost + 3, audit + "I")), (cost + 3, audit + "I"))
        for (r, state), (cost, audit) in list(open_.items()):
            if r != row:
                continue
            if row == len(signature):
                done += [(cost, audit)] if state in (0, 3) else []
                continue
            letter, more = signature[row], 3 if signature[row].isupper() else 0
            ways = [(state, cost + 4, audit + "D")]
            if letter != "d":
                ways.append((C.FOLLOWS[state][C.NEXT[state]], cost + 3 + more, audit + "R"))
                if letter.lower() in C.FOLLOWS[state]:
                    ways.append((C.FOLLOWS[state][letter.lower()], cost + more, audit + "K"))
            for to, c, a in ways:
                open_[row + 1, to] = min(open_.get((row + 1, to), (c, a)), (c, a))
    return min(done)


def test_long_signatures_and_shared_layers():
    rng = random.Random(3)
    some = sorted({"".join(rng.choice("suaxSUAXd" if rng.random() < 0.3 else "ua") for _ in range(rng.randint(0, 40))) for _ in range(400)} | {"ua" * k for k in range(30)})
    trie = C.Trie()
    for s in some:
        assert trie.insert(s) == plain_audit(s), s
    # A layer for each different prefix, and no more.
    assert trie.worked_out == len({s[:k] for s in some for k in range(1, len(s) + 1)})


def plain_row(conv_id, rows: list[tuple]) -> tuple:
    """The contract, read once more from its words. Rows: turn, role, text."""
    space = lambda x: " " if x is None else str(x)
    after = []
    for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, space(r[1]), space(r[2]))):
        hit = zlib.crc32(f"{space(conv_id)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        after += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    counts, signature, seen = [0, 0, 0], "", set()
    for _, role, text in after:
        solid = re.sub(r"[\x20\x09-\x0D]+", "", text)
        fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else 3
        seen.add((role, text))
        if fault < 3:
            counts[fault] += 1
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        signature += "d" if fault < 2 else letter.upper() if fault == 2 else letter
    turns = {t for t, _, _ in after if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(after))
    cost, audit = plain_audit(signature)
    out, written, row = [], "", 0
    for edit in audit:
        role = "assistant" if written.endswith("u") else "user"
        if edit == "I":
            out.append(f"{role}:")
        elif edit != "D":
            out.append(f"{after[row][1] if edit == 'K' else role}:{after[row][2]}")
        written += "" if edit == "D" else out[-1][:1]
        row += edit != "I"
    return conv_id, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_query_equals_the_contract(spark):
    rng, rows = random.Random(8), []
    texts = ["Yes.", "No", "", "  ", "Why? ", "So!\n", None, "same.", " ", "odd\x1c"]
    for conv in [*range(120), None]:
        rows += [(conv, rng.choice([t, t, t, None, t + 3]), rng.choice(["user", "assistant", "system", "tool", "", None, "user"]), rng.choice(texts)) for t in range(rng.randint(1, 9))]
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(300)] + [(501, 1, "user", "x.")] * 3
    dropped = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "x."))
    table = spark.createDataFrame([(*r, 1, "clash") for r in rows], "conv_id long, turn long, role string, text string, there int, audit string")
    got = {r[0]: r for r in rows_of(C.digests(C.repaired(C.damaged(table), scratch(spark))))}
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(tuple(rest))
    assert got == {c: plain_row(c, r) for c, r in by.items()}
    assert got[dropped][1:8] == (0, 0, 0, 0, 0, 0, "")


def test_real_outputs_and_an_empty_table(spark):
    rows = [(1, 0, "system", "Be kind.", True, 0), (1, 1, "assistant", "Hello.", True, 0), (1, 2, "assistant", "Hi.", True, 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, there boolean, place int")
    row = C.repaired(table, scratch(spark)).first()
    assert (row.audit, row.cost) == ("KRK", 3)
    assert [tuple(t) for t in row.turns] == [("system", "Be kind."), ("user", "Hello."), ("assistant", "Hi.")]
    assert C.digests(C.repaired(table.limit(0), scratch(spark))).collect() == []
