"""The n-gram join against brute force, with each way of reading texts again; odd tables."""

import random
import re

import pytest

from contagraph.llm import jaccard_join

WORDS = "the of and to in that is was for with on by this be as from".split()


def grams(text):
    w = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def corpus():
    """A large group of near copies, chains of them, copies, short texts, null and empty ones, null and repeated ids."""
    r = random.Random(11)
    text = lambda n: [f"{r.choice(WORDS)}{r.randint(0, 30)}" for _ in range(n)]
    rows = []
    body = text(90)
    for i in range(80):
        w = list(body)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"q{r.randint(0, 5)}"
        rows.append((i, " ".join(w)))
    chain = text(100)
    for i in range(80, 100):
        chain = chain[2:] + text(2)
        rows.append((i, " ".join(chain)))
    rows += [(i, " ".join(text(r.randint(1, 12)))) for i in range(100, 140)]
    rows += [(200, rows[0][1]), (None, rows[0][1].upper()), (None, rows[85][1]), (201, None), (202, ""), (203, " ! "), (204, "one"), (205, "One!"), (200, rows[101][1]), (206, "word " * 30_000)]
    return rows


@pytest.mark.parametrize("small", [jaccard_join.SMALL_IDS, 0])
def test_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard_join, "SMALL_IDS", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", 24)
    rows = corpus()
    sets = [grams(t) for _, t in rows]
    near = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    label = list(range(len(rows)))
    top = lambda i: i if label[i] == i else top(label[i])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and near(sets[i], sets[j]):
                label[top(i)] = top(j)
    want = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        copies = sum(s == sets[i] for s in sets) if sets[i] else 1
        links = len({s for s in sets if s and s != sets[i] and near(s, sets[i])}) if sets[i] else 0
        want.append((d, min(ids, default=None), copies, links))
    docs = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, rep int, `a.b` string")
    got = jaccard_join.similar(docs)
    assert sorted(map(tuple, got.select("doc_id", "class_id", "n_copies", "n_links").collect()), key=repr) == sorted(want, key=repr)
    assert sum(r["stays"] for r in got.collect()) == len({top(i) for i in range(len(rows))})
    assert jaccard_join.keep_one(docs).count() == len({top(i) for i in range(len(rows))})


def test_which_copy_stays_does_not_hang_on_partitions(spark):
    """Rows of one id and text but other columns: the same one stays, and the mix takes the same ones, however rows are dealt."""
    from contagraph.llm.mixing import mix

    rows = [(1, "one two three four five six seven", "s", i % 40, f"note {i * 7 % 40}" if i % 9 else None) for i in range(40)] + [(2, "a text of quite other words than that", "t", 0, "x")] * 2
    found = set()
    for n in (1, 3, 5, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int, note string").repartition(n)
        kept = sorted(map(tuple, jaccard_join.keep_one(docs).collect()))
        mixed = sorted(map(repr, map(tuple, mix(docs).collect())))
        found.add(repr((kept, mixed)))
    assert len(found) == 1 and len(kept) == 2 and kept[0] == (1, rows[0][1], "s", 0, None)
