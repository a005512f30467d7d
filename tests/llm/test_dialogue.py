"""Conversation repair against an exhaustive search, and long conversations against a plain dynamic programme."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from wardlens.llm import dialogue, queries

LEGAL = re.compile(r"(s?(ua)+)?\Z")
WHITE = "[\x20\x09-\x0d]"


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        if not re.search("[^\x20\x09-\x0d]", text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if re.search(f"[.!?]{WHITE}*\\Z", text) else "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


def exhaustive(rows, faults):
    """Least (cost, audit) of all edits that leave a legal conversation, by trying them all."""
    best = (3 * len(rows), "D" * len(rows), "")

    def go(i, roles, cost, audit, idle):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and LEGAL.match(roles) and (cost, audit) < best[:2]:
            best = (cost, audit, roles)
        if idle < 3:
            for r in "ua":
                go(i, roles + r, cost + 2, audit + "I", idle + 1)
        if i < len(rows):
            go(i + 1, roles, cost + 3, audit + "D", 0)
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                go(i + 1, roles + (rows[i][1][:1] or "?"), cost + more, audit + "K", 0)
                for r in "ua":
                    go(i + 1, roles + r, cost + 2 + more, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best[:2]


def plain_programme(rows, faults):
    """The same by the four states of the grammar with whole audits."""
    after = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    table = {"0": (0, "")}

    def insert(table):
        table = dict(table)
        for _ in range(4):
            for state, (cost, audit) in list(table.items()):
                for r in "ua":
                    if (state, r) in after:
                        way = (cost + 2, audit + "I")
                        to = after[state, r]
                        table[to] = min(table.get(to, way), way)
        return table

    for (_, role, _), fault in zip(rows, faults):
        new = {}
        for state, (cost, audit) in insert(table).items():
            ways = [(state, cost + 3, audit + "D")]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                ways += [(after.get((state, role[:1])), cost + more, audit + "K")]
                ways += [(after.get((state, r)), cost + 2 + more, audit + "R") for r in "ua"]
            for to, *way in ways:
                if to:
                    new[to] = min(new.get(to, tuple(way)), tuple(way))
        table = new
    table = insert(table)
    return min(table[s] for s in ("0", "a") if s in table)


def plain_summary(rows, solve):
    """The contract's columns of one conversation's rows (turn, role, text), in order."""
    faults = plain_faults(rows)
    cost, audit = solve(rows, faults)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    parts, state, left = [], "", list(rows)
    for letter in audit:
        # what an edit must give follows from the roles before it
        wanted = "a" if state == "u" else "u"
        if letter == "I":
            parts.append(dialogue.ROLES[wanted] + ":")
            state = wanted
            continue
        _, role, text = left.pop(0)
        if letter == "K":
            parts.append(f"{role}:{text}")
            state = role[:1]
        elif letter == "R":
            parts.append(f"{dialogue.ROLES[wanted]}:{text}")
            state = wanted
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
        hashlib.sha256("\n".join(parts).encode()).hexdigest())


def random_rows(rng, n, turns):
    texts = ["Hello there.", "And then", "Why?\n", " ", "", "No!", "x.", " ", "end. ", "...", "a? "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "s", "User"]
    return sorted([(rng.choice(turns), rng.choice(roles[:rng.choice((2, 3, 9))]), rng.choice(texts)) for _ in range(n)],
                  key=lambda r: (r[0] is not None, r[0] or 0))


def in_order(rows):
    mark = lambda t: hashlib.sha256(t.encode()).digest()[:16]  # noqa: E731 - ties of a turn go by role and hash
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), mark(r[2])))


def found_summaries(spark, conversations, whole=4096):
    rows = [(c, *r, "x") for c, rs in conversations.items() for r in rs]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, mark string").repartition(4)
    return {r.c: tuple(r)[1:] for r in dialogue.summaries(dialogue.repaired_turns(frame, whole)).collect()}


def test_short_conversations_match_exhaustive_search(spark):
    rng = random.Random(11)
    conversations = {c: in_order(random_rows(rng, rng.randrange(1, 6), [None, 0, 1, 2, 3, 4, 7, 9])) for c in range(250)}
    conversations[None] = in_order(random_rows(rng, 5, [0, 1, 2, 3]))
    found = found_summaries(spark, conversations)
    for c, rows in conversations.items():
        key = "" if c is None else f"={c}"
        assert found.pop(key) == plain_summary(rows, exhaustive), rows
    assert not found


@pytest.mark.parametrize("whole", [3, 4096])
def test_long_conversations_are_solved_by_pieces(spark, whole):
    rng = random.Random(whole)
    alternate = [(k, ("user", "assistant")[k % 2], f"t{k}.") for k in range(900)]
    conversations = {
        1: in_order([r for r in alternate if rng.random() > 0.1]),
        2: in_order(random_rows(rng, 700, list(range(400)) + [None])),
        3: in_order([(None, "user", "same.")] * 500 + [(5, "assistant", "b.")]),
        4: in_order([(k, "system", "same") for k in range(300)]),
        5: in_order([(0, "user", "x" * 300_000 + "."), (1, "assistant", "")]),
    }
    assert all(plain_programme(r, plain_faults(r)) == exhaustive(r, plain_faults(r)) for r in ([], conversations[5]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = found_summaries(spark, conversations, whole)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for c, rows in conversations.items():
        assert found[f"={c}"] == plain_summary(rows, plain_programme), c


def test_a_piece_gives_what_the_whole_gives():
    """Any cut of a conversation into pieces leads to the edits of the uncut one."""
    rng = random.Random(3)
    for _ in range(150):
        rows = [(rng.choice(["u", "a", "s", "t"]), rng.choice(["", "", "blank", "truncated"])) for _ in range(rng.randrange(1, 9))]
        whole = "".join(x for x, _ in dialogue._solve(tuple(rows)))
        cut = rng.randrange(len(rows) + 1)
        tops, _ = dialogue.walk({dialogue.STACKS.root: (0, 0)}, rows[:cut])
        tops, _ = dialogue.walk(tops, rows[cut:])
        cell, letters, _ = dialogue.finish(tops)
        _, moves = dialogue.walk({dialogue.STACKS.root: (0, 0)}, rows)
        assert "".join(x for x, _ in dialogue.steps(moves, cell)) + letters == whole


def test_grammar_with_a_choice_keeps_all_stacks():
    # "u a" is a pair, or a u and an a of their own
    stacks = dialogue.Stacks(((dialogue.START, ("x", "y")), (dialogue.START, ("p",)), ("x", ("u",)), ("y", ("a",)), ("p", ("u", "a"))))
    tops = stacks.shift(stacks.root, "u")
    assert len(tops) == 2 and sum(stacks.accepts(t) for top in tops for t in stacks.shift(top, "a")) == 2


def test_query_matches_plain_damage(spark, tmp_path):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["Good day.", "What", "Yes! No?", None, ""]))
            for c in [*range(60), None] for t in [None, *range(rng.randrange(1, 7))]]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    plain = {}
    for c, t, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        held = plain.setdefault(c, [])
        role, text = role or " ", " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        held += [(t, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    found = {r.conv_id: tuple(r)[1:] for r in queries.op11_dialogue(spark, str(tmp_path)).collect()}
    assert found == {c: plain_summary(in_order(r), plain_programme) for c, r in plain.items()}
    assert any(not r for r in plain.values()) or len(found) == 61


def test_no_conversations(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert dialogue.summaries(dialogue.repaired_turns(frame)).collect() == []
