"""Source divergence against plain Python, over several tiles and blocks, with nulls, repeats and clashing names."""

import random
import re
from collections import Counter, defaultdict

from contagraph.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=10, top=10):
    counts, holds, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang or "", source or ""].update(terms)
        holds[lang or ""].update(set(terms))
        groups[lang or ""].add(source or "")
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in holds[lang].items() if n >= least]
        every = Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})

        def weights(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: weights(counts[lang, s]) for s in sources}
        q = weights(every)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            marks = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(marks)[:top])):
                out += [(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


def rows_of(seed, n, sources):
    r = random.Random(seed)
    words = [f"{w}{'é' * (i % 3)}" for i, w in enumerate("alpha Beta GAMMA delta ÉTA zeta œuf theta 漢字 kappa lambda mu".split())] + [f"w{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(100)]
    rows = []
    for _ in range(n):
        k = r.randrange(sources)
        text = r.choice([" ", "-", "\n", "9", "_"]).join(r.choices(words, [1 + (i * k) % 7 for i in range(len(words))], k=r.randint(0, 40)))
        rows.append((text if r.random() < 0.95 else None, r.choice(["en", "de", "", None]), r.choice([f"s{k}", f"s{k}", "S é", None])))
    return [*rows, *rows[:5], ("lone words", "xx", "only"), ("", "yy", "a"), (None, "yy", "b"), ("word " * 100_000, "en", "s0")]


def test_against_plain_python(spark):
    rows = rows_of(1, 400, 6)
    got = divergence.divergence(spark.createDataFrame(rows, "text string, lang string, source string"))
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_many_tiles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GROUPS", 3)
    monkeypatch.setattr(divergence, "CELLS", 60)
    rows = rows_of(2, 500, 11)
    docs = spark.createDataFrame([(t, g, s, "x", 1) for t, g, s in rows], "body string, lang string, source string, term string, g int").repartition(5)
    got = divergence.divergence(docs, min_docs=5, top=3, text="body")
    assert sorted(map(tuple, got.collect())) == plain(rows, 5, 3)


def test_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_weights_are_exact():
    counts = [0, 1, 2, 10**12, 123_456_789_012_345]
    import numpy as np

    total = 987_654_321_098_765
    assert divergence.share(np.array(counts) + 2, total).tolist() == [1 + 10**9 * (c + 2) // total for c in counts]
