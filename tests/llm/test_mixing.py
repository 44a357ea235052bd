"""Source mixing against plain Python: targets, the reduction tree and every draw."""

import math
import random
import struct
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from contagraph.llm import mixing

BLANKS = " \t\n\x0b\x0c\r"


def h64(*values):
    """Spark's xxhash64: longs and ints by their bytes, text by UTF-8, nulls passed over."""
    seed = 42
    for kind, v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if kind == "s" else struct.pack("<q" if kind == "l" else "<i", v), seed=seed)
    return seed - 2**64 if seed >= 2**63 else seed


def uniform(*keys):
    return ((h64(("i", mixing.SEED), *keys) & (2**64 - 1)) >> 11) * 2.0**-53


def words(text):
    n, inside = 0, False
    for c in text or "":
        n += (c not in BLANKS) and not inside
        inside = c not in BLANKS
    return n


def targets(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    left, open_, out = float(sum(sizes.values())), dict(zip(names, (weights[i % len(weights)] for i in range(len(names))))), {}
    while open_:
        share = left / sum(open_.values())
        capped = [s for s in open_ if share * open_[s] > most * sizes[s]]
        if not capped:
            return out | {s: share * w for s, w in open_.items()}
        for s in capped:
            out[s] = float(most * sizes[s])
            left -= out[s]
            del open_[s]
    return out


def plain(rows, weights=mixing.WEIGHTS, most=mixing.MAX_COPIES, block=mixing.BLOCK):
    items, seen = [], defaultdict(int)
    for doc, source, text in rows:
        key = (doc, source, words(text))
        seen[key] += 1
        items.append((*key, seen[key]))
    total, count = defaultdict(int), defaultdict(int)
    for _, s, n, _ in items:
        total[s] += n
        count[s] += 1
    goal = targets(total, weights, most)
    blocks, taken = defaultdict(list), {}
    for item in items:
        doc, s, n, copy = item
        want = goal[s] / total[s] if total[s] else 0.0
        whole = math.floor(want + 1e-9)
        p = max(0.0, want - whole)
        key = h64(("i", mixing.SEED), ("l", doc), ("s", s), ("l", n), ("i", copy))
        taken[item] = whole
        if p > 1e-9 and n:
            at = h64(("i", mixing.SEED + 1), ("l", key)) % math.ceil(count[s] / (block * 3 // 4))
            blocks[s, at].append([key, p, float(n), item])
        elif uniform(("i", -1), ("l", key)) < p:
            taken[item] += 1
    n_blocks, level = -(-max(count.values()) // (block * 3 // 4)), 0
    while True:
        left = {}
        for at, found in blocks.items():
            o = None
            for x in sorted(found, key=lambda v: v[0]):
                if o is None:
                    o = x
                    continue
                to_o, to_x = min(1 - o[1], x[1] * x[2] / o[2]), min(o[1], (1 - x[1]) * x[2] / o[2])
                if uniform(("i", level), ("l", o[0]), ("l", x[0])) * (to_o + to_x) < to_x:
                    o[1], x[1] = o[1] + to_o, x[1] - to_o * o[2] / x[2]
                else:
                    o[1], x[1] = o[1] - to_x, x[1] + to_x * o[2] / x[2]
                still = [v for v in (o, x) if 1e-9 <= v[1] <= 1 - 1e-9]
                for v in (o, x):
                    if v not in still:
                        taken[v[3]] += v[1] > 0.5
                assert len(still) <= 1
                o = still[0] if still else None
            if o is not None:
                left[at] = o
        if n_blocks <= 1:
            break
        blocks = defaultdict(list)
        for (s, at), o in left.items():
            blocks[s, at // block].append(o)
        n_blocks, level = -(-n_blocks // block), level + 1
    for o in left.values():
        taken[o[3]] += uniform(("i", level + 1), ("l", o[0])) < o[1]
    return sorted(((doc, s, n, copy, total[s], round(goal[s], 6), min(most, k), min(most, k) * n) for (doc, s, n, copy), k in taken.items()), key=repr)


@pytest.mark.parametrize("broadcast", [mixing.BROADCAST_SOURCES, 0])
def test_against_plain_python(spark, monkeypatch, broadcast):
    """A source with half of all rows, one of a few words, empty and null texts, null sources and ids, repeated rows."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    r = random.Random(8)
    text = lambda: "".join(r.choice(["w", "é", "xy", " ", "\t", "\x0b ", "\n"]) for _ in range(r.randint(0, 80)))
    rows = [(i, "big" if i % 2 else r.choice(["a", "B", "é", None, "z", "tiny"]), text()) for i in range(5000)]
    rows = [(d, s, "one word" if s == "tiny" else t) for d, s, t in rows]
    rows += [(1, "big", None), (1, "big", None), (None, "a", "x y z"), (None, "a", "z y x"), (None, None, ""), (7, "none", None), (8, "long", "word " * 100_000)] + rows[:20]
    got = mixing.mixing_decisions(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert sorted(((*tuple(x)[:5], round(x["target"], 6), x["copies"], x["taken"]) for x in got), key=repr) == plain(rows)


def test_targets_of_many_sources(spark):
    r = random.Random(2)
    sizes = {(f"host{i}" if i else None): r.choice([0, 1, 5, 400, 90_000]) for i in range(700)}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {x["source"]: x["target"] for x in mixing.source_targets(rows).collect()}
    want = targets(sizes, mixing.WEIGHTS, mixing.MAX_COPIES)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9) for s in want)
    assert mixing.source_targets(rows.limit(0)).count() == 0


def test_mix_takes_what_is_decided(spark):
    rows = [(i, "ab"[i % 2], "w " * (i % 7), i) for i in range(300)] + [(None, "a", "x", 1000), (None, "a", "x", 1001)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, `copy` int")
    mixed = mixing.mix(docs).groupBy("doc_id", "source", "text", "copy").agg(F.count("*").alias("n")).collect()
    decided = defaultdict(int)
    for d in mixing.mixing_decisions(docs).collect():
        decided[d["doc_id"], d["source"]] += d["copies"]
    got = defaultdict(int)
    for m in mixed:
        got[m["doc_id"], m["source"]] += m["n"]
    assert got == {k: v for k, v in decided.items() if v}
