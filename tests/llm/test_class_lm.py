"""The class model against plain Python: clustering by its likelihood, counts, classes and scores from scratch."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from contagraph.llm import class_lm

RARE = "Pneumonoultramicroscopicsilicovolcanoconiosis"


def corpus(seed, n):
    r = random.Random(seed)
    nouns, verbs, rest = [f"noun{i}" for i in range(12)], [f"verb{i}s" for i in range(9)], ["the", "a", "every", "no"]
    line = lambda: f"{r.choice(rest)} {r.choice(nouns)} {r.choice(verbs)} {r.choice(rest).upper()}\t{r.choice(nouns)}"
    return [" ".join(line() for _ in range(r.randint(1, 6))) + (f" once{i}" if i % 3 == 0 else "") for i in range(n)]


def likelihood(bigrams, cls):
    one = np.eye(cls.max() + 1)[cls]
    t = one.T @ bigrams @ one
    f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
    return f(t) - f(t.sum(0)) - f(t.sum(1))


def test_exchange_ends_where_no_move_helps():
    rng = np.random.default_rng(5)
    for m, classes in ((9, 4), (20, 6)):
        bigrams = rng.poisson(rng.gamma(0.4, 4, (m, m))).astype(np.float32)
        cls = class_lm.exchange_clusters(bigrams, classes, rounds=100)
        assert cls[-1] == 0 and (cls[:-1] > 0).all() and cls.max() < classes
        best = likelihood(bigrams, cls)
        for w in range(m - 1):
            for d in range(1, classes):
                moved = cls.copy()
                moved[w] = d
                moved = np.unique(np.append(moved, np.arange(classes)), return_inverse=True)[1][:m]
                assert likelihood(bigrams, moved) <= best + 1e-3
    assert class_lm.exchange_clusters(np.zeros((1, 1), np.float32)).tolist() == [0]


def split(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").split()


@pytest.mark.parametrize("clustered", [4, 10])
def test_scores_from_scratch(spark, clustered):
    texts = [*corpus(1, 40), None, "", f"the {RARE} {RARE}", "the " * 3000]
    asked = [*corpus(2, 10), None, f"{RARE.lower()} unseen words Verb1S", *texts[:3]]
    groups, classes, frequent = 5, 4, 14
    frame = lambda rows: spark.createDataFrame([(i, t, 0) for i, t in enumerate(rows)], "doc_id long, text string, codes int")
    model, counts = class_lm.train(frame(texts), clustered, groups, classes, frequent)
    got = {r["doc_id"]: r for r in class_lm.score(frame(asked), model, counts, keep=("doc_id", "codes")).collect()}

    c = Counter(w for t in texts for w in split(t))
    n, v, n_docs = sum(c.values()) + len(texts), len(c) + 1, len(texts)
    assert (model.n, model.v) == (n, v)
    top = [w.decode() if not w.startswith(b"\0") else RARE.lower() for w in model.words]
    least = min(c[w] for w in top)
    assert len(top) <= frequent and all(c[w] < least for w in c if w not in top) and top == sorted(top, key=lambda w: (-c[w], class_lm._key(w.encode())))
    group = lambda w: class_lm.suffix_group(w.encode(), groups)
    k = min(clustered, len(top))
    first = {w: i for i, w in enumerate(top[:k])}
    unit = lambda w: first.get(w, k + group(w))
    big = np.zeros((k + groups + 1,) * 2, np.float32)
    for t in texts:
        seq = [k + groups, *map(unit, split(t)), k + groups]
        np.add.at(big, (seq[:-1], seq[1:]), 1)
    cls = class_lm.exchange_clusters(big, classes)
    m = int(cls.max()) + 1

    def transitions(kind):
        trans = np.zeros((m, m))
        for t in texts:
            seq = [0, *map(kind, split(t)), 0]
            np.add.at(trans, (seq[:-1], seq[1:]), 1)
        share = (trans.sum(0) + 0.5) / (trans.sum() + 0.5 * m)
        mu = (trans > 0).sum(1, keepdims=True) + 1
        return trans, np.log10((trans + mu * share) / (trans.sum(1, keepdims=True) + mu))

    by_unit = lambda w: cls[unit(w)]
    trans, chain = transitions(by_unit)
    own = {w: cls[i] for w, i in first.items()}
    for w in top[k:]:
        gain = np.zeros(m)
        for t in texts:
            seq = [None, *split(t), None]
            for x, y, z in zip(seq, seq[1:], seq[2:]):
                if y == w:
                    before, after = (0 if u is None else by_unit(u) for u in (x, z))
                    gain += chain[before] + chain[:, after] - np.log10(trans.sum(0) + 0.5)
        gain[0] = -np.inf
        own[w] = int(np.argmax(np.round(gain, 6)))
    final = lambda w: own.get(w, cls[k + group(w)])
    trans, chain = transitions(final)
    size = trans.sum(0)
    rare = [w for w in c if w not in top]
    in_group = [sum(c[w] for w in rare if group(w) == g) for g in range(groups)]
    kinds_in_group = [sum(group(w) == g for w in rare) for g in range(groups)]
    units = Counter([*(own[w] for w in top), *(cls[k + g] for g in range(groups)), 0])

    def emission(w):
        if w in own:
            return math.log10((c[w] + 0.5) / (size[own[w]] + 0.5 * units[own[w]]))
        g = group(w)
        return math.log10((in_group[g] + 0.5) / (size[cls[k + g]] + 0.5 * units[cls[k + g]])) + math.log10((c[w] + 0.5) / (in_group[g] + 0.5 * (kinds_in_group[g] + 1)))

    for i, t in enumerate(asked):
        words = split(t)
        seq = [0, *map(final, words), 0]
        want = sum(map(emission, words)) + math.log10((n_docs + 0.5) / (size[0] + 0.5 * units[0])) + sum(chain[a, b] for a, b in zip(seq, seq[1:]))
        base = sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in [*(c[w] for w in words), n_docs])
        assert got[i]["n_tokens"] == len(words) + 1 and got[i]["n_known"] == sum(c[w] > 0 for w in words) + 1
        assert got[i]["base_score"] == pytest.approx(base, abs=1e-9) and got[i]["score"] == pytest.approx(want, abs=1e-6)


def test_words_beyond_the_clustered_have_classes_of_their_own(spark):
    """Nouns and verbs end alike, so only their neighbours tell the rarer ones apart."""
    r = random.Random(4)
    nouns, verbs = [f"{x}{y}ing" for x in "bcdfg" for y in "aeiou"], [f"{x}{y}ing" for x in "klmnp" for y in "aeiou"]
    odds = [20] * 8 + [1] * 17
    rows = spark.createDataFrame([(i, " ".join(f"the {r.choices(nouns, odds)[0]} will {r.choices(verbs, odds)[0]} ." for _ in range(60))) for i in range(20)], "doc_id long, text string")
    model, _ = class_lm.train(rows, clustered=19, classes=6)
    kinds = {w.decode(): k for w, k in zip(model.words, model.cls)}
    assert len(kinds) == 53 and class_lm.suffix_group(b"baing") == class_lm.suffix_group(b"kaing")
    assert {kinds[w] for w in nouns[8:]} == {kinds[nouns[0]]} != {kinds[verbs[0]]} == {kinds[w] for w in verbs[8:]}


def test_training_and_scoring_in_one_go(spark):
    """The same as train() and score() apart; repeated rows score alike, an empty table gives no row."""
    rows = spark.createDataFrame([(i % 25, t, "x") for i, t in enumerate(corpus(7, 30) + [None])], "doc_id long, text string, rare string")
    part = rows.doc_id % 3 != 0
    both, model = class_lm.train_and_score(rows, part, ("doc_id", "rare"))
    other, counts = class_lm.train(rows.where(part))
    apart = class_lm.score(rows, other, counts, keep=("doc_id", "rare"))
    assert model.n == other.n and both.columns == apart.columns
    near = lambda df: sorted((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 8), round(r["score"], 8)) for r in df.collect())
    assert near(both) == near(apart) and len(near(both)) == 31
    empty, _ = class_lm.train_and_score(rows.limit(0), part)
    assert empty.count() == 0
