"""Conversation repair against a search over whole conversations, with blocks cut short, nulls, ties, repeats and empty tables."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import product

import pytest

from contagraph.llm import conversations

GOAL = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1))
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for k, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Uniform-cost search over rows used and the initials so far, which only their last one matters of."""
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, initials, lines = heapq.heappop(queue)
        if i == len(rows) and GOAL.fullmatch(initials):
            return cost, audit, "\n".join(lines)
        if (i, initials) in done:
            continue
        done.add((i, initials))

        def go(more, edit, step, role=None, text=""):
            now = initials + (role[:1] if role else "")
            if GOAL.fullmatch(now) or GOAL.fullmatch(now + "a") or GOAL.fullmatch(now + "ua"):
                # a long way is the same as its last pair
                now = now if len(now) < 4 else now[:-2]
                heapq.heappush(queue, (cost + more, audit + edit, i + step, now, lines + ((f"{role}:{text}",) if role else ())))

        if i < len(rows):
            _, role, text = rows[i]
            go(2, "D", 1)
            if found[i] not in ("b", "d"):
                more = 5 if found[i] == "t" else 0
                if role:
                    go(more, "K", 1, role, text)
                for to in ("user", "assistant"):
                    go(1 + more, "R", 1, to, text)
        if audit[-4:] != "IIII":
            for to in ("user", "assistant"):
                go(5, "I", 0, to)


def plain(rows):
    out = []
    for conv, mine in damage(rows).items():
        found = faults(mine)
        cost, audit, text = cheapest(mine, found)
        turns = [t for t, _, _ in mine if t is not None]
        gaps = min(max(turns) - min(turns) + 1 - len(set(turns)), 2**63 - 1) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out.append((conv, gaps, *(found.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversation(r, conv, n):
    rows = []
    for t in range(n):
        turn = r.choice([t, t, t, t + r.randint(0, 3), None])
        text = r.choice(["Yes.", "No!", "Why?", "Well", "Then é. ", " ", "", "\t\x0b", f"Line {t}\nof {conv}.", f"cut {t}", None, "a:b.", "\xa0"])
        rows.append((conv, turn, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "uncle", "", None]), text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, rows, schema=SCHEMA):
    return sorted(map(tuple, conversations.repair(conversations.damaged(spark.createDataFrame(rows, schema))).collect()), key=repr)


@pytest.mark.parametrize("block", [200, 3])
def test_against_search(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    r = random.Random(block)
    rows = [row for c in range(150) for row in conversation(r, c if c else None, r.randint(0, 9))]
    rows += conversation(r, 1000, 60) + [(2000, 5, "user", "Hi.")] * 30 + [(2001, None, "user", "Hi.")] * 7 + [(2002, i, "assistant", "Same.") for i in range(25)]
    rows += [(2003, -(2**63), "user", "One."), (2003, None, "user", "One."), (2003, 2**63 - 2**62, "assistant", "Two."), (2004, 1, "user", "long. " * 100_000)]
    r.shuffle(rows)
    assert run(spark, rows) == plain(rows)


def test_edits_of_short_blocks_against_all():
    def ways(letters, state):
        if not letters:
            yield 0, "", state
            return
        for n in range(3):
            at = state
            for _ in range(n):
                at = {"-": "u", "s": "u", "u": "a", "a": "u"}[at]
            c = letters[0]
            moves = [(2, "D", at)]
            if c != "x":
                more = 5 * c.isupper()
                moves += [(1 + more, "R", {"-": "u", "s": "u", "u": "a", "a": "u"}[at])]
                if (at, c.lower()) in {("-", "s"), ("-", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    moves.append((more, "K", c.lower()))
            for cost, edit, to in moves:
                for rest, edits, end in ways(letters[1:], to):
                    yield 5 * n + cost + rest, "I" * n + edit + edits, end

    for letters in map("".join, product("suaoUx", repeat=3)):
        want = {}
        for state in "-sua":
            for cost, edits, end in ways(letters, state):
                want[state, end] = min(want.get((state, end), (cost, edits)), (cost, edits))
        assert conversations.solve(letters) == want


def test_extra_columns_other_types_and_empty_tables(spark):
    rows = [("c:1", 1, "user", "A.", "x", 0), ("c:1", 2, "assistant", "B.", "y", 1), (None, None, None, None, None, None)]
    got = run(spark, rows, "conv_id string, turn int, role string, text string, audit string, block int")
    assert got == plain([r[:4] for r in rows])
    assert run(spark, []) == []


def test_one_conversation_holds_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 20)
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(2000)] + [(2 + i // 4, i % 4, "user" if i % 2 == 0 else "assistant", "x.") for i in range(4000)]
    faulty = conversations.damaged(spark.createDataFrame(rows, SCHEMA))
    got = conversations.repair(faulty)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)
