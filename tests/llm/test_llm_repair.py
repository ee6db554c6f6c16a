"""Conversation repair against all edit scripts, and its handling of odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cache

import numpy as np
import pytest

from pocketlake.llm import conversation_repair as repair

WORDS = ("One two.", "three", "", " \t", "One two.", "why?", "no end, ", "ß!", "end.\n ")


def plain(rows):
    """Every field of the query for the (turn, role, text) rows of one conversation after damage, by trying all edits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\r\x0b\x0c")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    states = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(at, state):
        """(cost, edits, lines) of the cheapest and then least way to the end; a row may be inserted before another edit at most twice."""
        ways = []

        def inserts(state, cost, edits, lines, left):
            if at == len(rows):
                if state in ("", "a"):
                    ways.append((cost, edits, lines))
            else:
                _, role, text = rows[at]
                more = 1 if faults[at] == "truncated" else 0
                options = [(3, "D", state, ())]
                if faults[at] not in ("blank", "duplicate"):
                    if role[:1] in states[state] if role else True:
                        options.append((more, "K", role[:1] or state, (f"{role}:{text}",)))
                    options += [(2 + more, "R", new[0], (f"{new}:{text}",)) for new in ("user", "assistant") if new[0] in states[state]]
                for price, edit, then, line in options:
                    rest = best(at + 1, then)
                    if rest:
                        ways.append((cost + price + rest[0], edits + edit + rest[1], (*lines, *line, *rest[2])))
            if left:
                for new in ("user", "assistant"):
                    if new[0] in states[state]:
                        inserts(new[0], cost + 2, edits + "I", (*lines, f"{new}:"), left - 1)

        inserts(state, 0, "", (), 2)
        return min(ways) if ways else None

    cost, edits, lines = best(0, "")
    initials = "".join(line[0] for line in lines if line[0] != ":")
    assert re.fullmatch("(s?(ua)+)?", initials)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)), cost, edits,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        kept += [(turn, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    return out


def drawn(seed, conversations, most):
    random = np.random.default_rng(seed)
    roles = ("user", "assistant", "system", "user", "assistant", "tool", "", None)
    rows = []
    for conv in range(conversations):
        for turn in range(random.integers(1, most)):
            text = WORDS[random.integers(len(WORDS))] if random.random() < 0.5 else f"w{random.integers(99)}."
            at = None if random.random() < 0.1 else int(turn if random.random() < 0.9 else turn // 2)
            rows.append((conv if conv else None, at, roles[random.integers(len(roles))], None if random.random() < 0.05 else text))
    return rows


KINDS = "conv_id long, turn long, role string, text string"


def test_audits_against_all_edits(spark):
    rows = drawn(3, 150, 9)
    found = repair.audits(repair.damaged(spark.createDataFrame(rows, KINDS).repartition(7))).collect()
    want = {conv: plain(kept) for conv, kept in plain_damage(rows).items()}
    assert {r.conv_id: tuple(r)[1:] for r in found} == want and len(found) == len(want)
    # Every edit occurs, and so does a conversation without rows left.
    assert set("".join(r.audit for r in found)) == set("DIKR")


def test_rows_of_the_repair(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "b.")]
    found = sorted(map(tuple, repair.repair(spark.createDataFrame(rows, KINDS)).collect()))
    assert found == [(1, 1, "K", "user", "a."), (1, 2, "I", "assistant", ""), (1, 3, "K", "user", "b."), (1, 4, "K", "assistant", "b.")]


def test_long_conversation_keeps_few_checkpoints():
    random = np.random.default_rng(5)
    rows = [(("user", "assistant", "system", "x")[random.integers(4)], f"{n}" + "." * int(random.integers(2)), int(random.integers(4))) for n in range(20_000)]
    checks = repair.Checkpoints()
    for role, _, fault in reversed(rows):
        checks.add(role[:1], fault)
    assert len(checks.held) <= 2 * checks.every and checks.every <= 2 * 20_000**0.5
    walk, edits, longest = repair.Walk(checks), [], 0
    for row in rows:
        edits += walk.add(*row)
        longest = max(longest, len(walk.block))
    edits += walk.end()
    assert longest < checks.every
    # The same edits with the costs of every row held.
    costs = [repair.AT_END]
    for role, _, fault in reversed(rows):
        costs.append(repair.before(role[:1], fault, costs[-1]))
    costs.reverse()
    state, want, at = repair.START, "", 0
    while at < len(rows) or state not in (repair.START, repair.ASSISTANT):
        due, options = costs[at][state], {"I": (repair.INSERT + costs[at][repair.NEXT[state]], repair.NEXT[state])}
        if at < len(rows):
            role, _, fault = rows[at]
            delete, keep, rerole = repair.edit_costs(state, role[:1], fault, costs[at + 1])
            options |= {"D": (delete, state), "K": (keep, repair.follow(state, role[:1])), "R": (rerole, repair.NEXT[state])}
        edit = min(e for e, (cost, _) in options.items() if cost == due)
        want, state, at = want + edit, options[edit][1], at + (edit != "I")
    assert "".join(e[0] for e in edits) == want


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)], [(1, None, "user", "Hi.")] * 3, [(7, 0, "user", "x" * 300_000 + ".")]])
def test_odd_rows(spark, rows):
    table = spark.createDataFrame(rows, KINDS).selectExpr("*", "role AS conv", "turn AS place", "text AS fault", "1 AS dropped")
    found = repair.audits(repair.damaged(table)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == {conv: plain(kept) for conv, kept in plain_damage(rows).items()}
    assert repair.repair(table).count() >= 0
