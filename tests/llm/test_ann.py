"""Collision-counting search: share verified and recall over many vectors; ties, repeats and odd vectors against brute force."""

import numpy as np

from contagraph.llm import collision_ann as ann


def searched(x, queries, k=20, block=8192):
    """Ids found by each query over all blocks, as nearest() goes about it, and the share of vectors verified."""
    ids, longest, verified = np.arange(len(x)), np.linalg.norm(x, axis=1).max() * (1 + 1e-9), 0
    found, bounds = {int(q): [] for q in queries}, np.full(len(queries), np.nan)
    for b in range(0, len(x), block):
        index = ann.SortedProjections(ids[b : b + block], x[b : b + block], longest)
        for qid, at, scores in index.search(queries, x[queries], k, bounds):
            found[qid] += zip((-scores).tolist(), index.ids[at].tolist())
        verified += index.verified
        if b == 0:
            worst = np.array([-sorted(found[int(q)])[k - 1][0] for q in queries])
            bounds = np.sqrt(np.maximum(2 * longest**2 - 2 * longest / np.linalg.norm(x[queries], axis=1) * worst, 1e-12))
    return {q: {i for _, i in sorted(f)[:k]} for q, f in found.items()}, verified / len(x) / len(queries)


def exact(x, q, k=20):
    s = (x * x[q]).sum(1)
    s[q] = -np.inf
    return set(np.lexsort((np.arange(len(x)), -s))[:k].tolist())


def test_few_vectors_are_verified():
    """Unit vectors without any structure, the hardest case: under a fifth is verified, recall over 0.95; less among more vectors."""
    rng, shares = np.random.default_rng(3), []
    for n in (8192, 40_960):
        x = rng.standard_normal((n, 64))
        x /= np.linalg.norm(x, axis=1)[:, None]
        queries = np.arange(0, n, n // 100)
        found, share = searched(x, queries)
        recall = np.mean([len(found[int(q)] & exact(x, q)) / 20 for q in queries])
        shares.append(share)
        assert recall >= 0.95 and share < 0.2
    assert shares[1] < shares[0]


def test_clusters_are_pruned():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((150, 64))[rng.integers(0, 150, 24_576)] + 0.3 * rng.standard_normal((24_576, 64))
    queries = np.arange(0, len(x), 300)
    found, share = searched(x, queries)
    assert np.mean([len(found[int(q)] & exact(x, q)) / 20 for q in queries]) > 0.97 and share < 0.1


def test_many_blocks_against_brute_force(spark):
    """Ranges and blocks of equal vectors, queries among and beside the vectors, and rows that take no part."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1200, 6))
    x[::3] = x[0]
    x[5] *= 40
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    odd = [(2000, [float("inf")] + [1.0] * 5, "x"), (2001, [None] + [1.0] * 5, "x"), (2002, [1.0] * 7, "x"), (2003, [], "x"), (None, [1.0] * 6, "x")]
    asked = [(i, x[i].tolist(), "x") for i in range(0, 1200, 40)] + [(5000, [0.5] * 6, "x"), (5001, [-1e-9] * 6, "x"), (5002, None, "x"), (5003, [0.0] * 6, "x")]
    schema = "vec_id long, embedding array<double>, query_id string"
    got = ann.nearest(spark.createDataFrame(rows + odd, schema), spark.createDataFrame(asked, schema), k=10, block=100).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == {i for i, v, _ in asked if v is not None and any(v)}
    hits = 0
    for i, v, _ in asked[:-2]:
        mine = sorted(by[i])
        s = (x * np.array(v)).sum(1)
        if i < 1200:
            s[i] = -np.inf
        best = np.lexsort((np.arange(1200), -s))[:10]
        assert [r for r, _, _ in mine] == list(range(1, 11)) and [j for _, j, _ in mine] == sorted((j for _, j, _ in mine), key=lambda j: (-s[j], j))
        assert all(abs(c - s[j]) <= 1e-12 * max(1, abs(c)) for _, j, c in mine)
        hits += len({j for _, j, _ in mine} & set(best.tolist()))
    assert hits >= 0.95 * 10 * len(asked[:-2])


def test_repeated_ids(spark):
    """Of rows that repeat an id the one of the smallest vector takes part, once."""
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (2, [0.0, 1.0]), (3, [0.5, 0.5]), (3, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.nearest(df, df, k=5).collect()))
    assert got == [(1, 1, 3, 0.5), (1, 2, 2, 0.0), (2, 1, 3, 0.5), (2, 2, 1, 0.0), (3, 1, 1, 0.5), (3, 2, 2, 0.5)]
    assert ann.nearest(df, df.limit(0)).count() == ann.nearest(df.limit(0), df).count() == 0
