"""Nearest neighbours by collision counting: query-centred windows on sorted single projections, widened step by step.

Largest inner product becomes smallest distance by one more coordinate: vectors of norm up to M get sqrt(M^2 - norm^2),
the query is scaled to norm M. The first projection, sorted, is cut into ranges; a range of more than BLOCK vectors is
dealt into blocks, which split even equal vectors. Each block keeps PROJECTIONS sorted arrays. At a radius R a query's
window on each array is the values within WIDTH * R of its centre; a vector in at least COLLISIONS of the windows is
verified with its exact inner product. Collisions are counted from the shorter side: what lies outside the windows.

First a query searches one block of its own range, its windows widening (virtual rehashing: no new index) until the radius
reaches the k-th of the verified vectors. That distance bounds what is left: the query then goes to the blocks whose
range its window of REACH * R meets, and in each it counts once, at that radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contagraph.llm.common import col, stash, table

K, EVERY = 20, 20
PROJECTIONS, COLLISIONS, WIDTH, START, WIDEN, REACH, SEED = 128, 0.92, 1.9, 1.0, 1.15, 3.5, 7
#: Vectors of a block (about; below 2**16), queries of a task, and ranges of the first projection.
BLOCK, QUERIES, RANGES = 8192, 1024, 1024


def projections(dim: int) -> np.ndarray:
    """One row of random numbers a projection; the last column is for the added coordinate."""
    return np.random.default_rng(SEED).standard_normal((PROJECTIONS, dim + 1))


class SortedProjections:
    """The index of one block: ids, vectors and its sorted projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float) -> None:
        self.ids, self.vectors, self.longest, self.verified = ids, vectors, longest, 0
        rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
        self.axes = projections(vectors.shape[1])
        spread = self.axes[:, :-1] @ vectors.T + self.axes[:, -1:] * rest
        order = np.argsort(spread, 1)
        self.sorted = np.take_along_axis(spread, order, 1)
        self.order = order.astype(np.uint16 if len(ids) < 1 << 16 else np.int64)

    def _edges(self, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of each query's window on each array, at radii (one a query, or more)."""
        half = WIDTH * radii
        low = np.stack([np.searchsorted(s, c - half, "left") for s, c in zip(self.sorted, centres)])
        return low, np.stack([np.searchsorted(s, c + half, "right") for s, c in zip(self.sorted, centres)])

    def _outside(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each vector the windows that it lies outside of."""
        pieces = [o[:a] for o, a in zip(self.order, low)] + [o[a:] for o, a in zip(self.order, high)]
        return np.bincount(np.concatenate(pieces), minlength=len(self.ids))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query: its id, and positions and scores of its k best verified vectors, nearest first.

        bounds: a distance within which the query's k nearest are known to lie; nan where none is known. Such queries
        start at a narrow window, which widens.
        """
        n, spare = len(self.ids), PROJECTIONS - int(np.ceil(COLLISIONS * PROJECTIONS))
        scales = self.longest / np.linalg.norm(queries, axis=1)
        centres = self.axes[:, :-1] @ (queries * scales[:, None]).T
        open_ = np.isnan(bounds)
        every = max(1, n // 256)
        probe = np.where(self.ids[::every, None] == query_ids, -np.inf, self.vectors[::every] @ queries.T).max(0)
        guess = START * np.sqrt(np.clip(2 * self.longest**2 - 2 * scales * probe, 1e-12 * self.longest**2, 4 * self.longest**2))
        radii = np.where(open_, guess, bounds)
        low, high = self._edges(centres, radii)
        for i, (qid, q) in enumerate(zip(query_ids, queries)):
            missed, radius = self._outside(low[:, i], high[:, i]), radii[i]
            lo, hi = low[:, i], high[:, i]
            found = np.zeros(n, bool)
            at, scores = np.zeros(0, np.int64), np.zeros(0)
            widen = WIDEN
            while True:
                fresh = np.flatnonzero((missed <= spare) & ~found)
                found[fresh] = True
                self.verified += len(fresh)
                fresh = fresh[self.ids[fresh] != qid]
                at, scores = np.concatenate([at, fresh]), np.concatenate([scores, (self.vectors[fresh] * q).sum(1)])
                if not open_[i] or radius > 2 * self.longest:
                    break
                # k verified vectors bound the distance of the k nearest; without them the window widens step by step
                bound = np.inf
                if len(scores) >= k:
                    bound = np.sqrt(max(0.0, 2 * self.longest**2 - 2 * scales[i] * np.partition(scores, len(scores) - k)[len(scores) - k]))
                    if bound <= radius:
                        break
                radius, widen = min(radius * widen, bound), widen**1.5
                if radius > 2 * self.longest:  # the last window holds everything
                    lo2, hi2 = np.zeros_like(lo), np.full_like(hi, n)
                else:
                    lo2, hi2 = (e[:, 0] for e in self._edges(centres[:, i : i + 1], np.array([radius])))
                    lo2, hi2 = np.minimum(lo, lo2), np.maximum(hi, hi2)
                entered = [o[a:b] for o, a, b in zip(self.order, lo2, lo)] + [o[a:b] for o, a, b in zip(self.order, hi, hi2)]
                missed -= np.bincount(np.concatenate(entered), minlength=n)
                lo, hi = lo2, hi2
                if np.isfinite(bound):
                    open_[i] = radius < bound
            best = np.lexsort((self.ids[at], -scores))[:k]
            yield int(qid), at[best], scores[best]


def _dot(v, axis) -> F.Column:
    return F.aggregate(F.zip_with(v, F.array(*[F.lit(float(a)) for a in axis]), lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries its k nearest rows of vectors by inner product.

    Vectors that are null, all zero, of another length than the most common one's, or hold a null or non-finite component
    take no part, nor do null ids. Of rows that repeat an id, in either table, the one of the smallest vector takes part.
    A query's own id is not its neighbour. Ties go to the smaller id. Every vector is in exactly one block. Extra columns
    don't matter; an empty table, on either side, gives no row.
    """

    def clean(df: DataFrame) -> DataFrame:
        v = F.transform(col(embedding), lambda x: x.cast("double"))
        ok = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(col(vec_id).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(ok, F.lit(False)))

    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    base = clean(vectors)
    sizes = base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm2).alias("most")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim, most = (sizes[0]["d"], sizes[0]["most"]) if sizes else (1, 1.0)
    longest = float(np.sqrt(most)) * (1 + 1e-9)
    once = lambda df: df.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    axis = projections(dim)[0]
    rest = F.sqrt(F.greatest(longest**2 - norm2, F.lit(0.0)))
    base = stash(once(base).select("id", "v", (_dot(F.col("v"), axis[:-1]) + float(axis[-1]) * rest).alias("c")), "ann-vectors")
    asked = stash(once(clean(queries)).select("id", "v", (_dot(F.col("v"), axis[:-1]) * longest / F.sqrt(norm2)).alias("c")), "ann-queries")

    n = base.count()
    pieces = min(RANGES, max(1, -(-n // block)))
    cuts = (base.agg(F.percentile_approx("c", [i / pieces for i in range(1, pieces)], 10_000)).first()[0] or []) if pieces > 1 and n else []
    cuts = sorted(set(cuts))  # RANGES - 1 at most
    edges = F.array(*[F.lit(float(x)) for x in cuts]) if cuts else F.array().cast("array<double>")
    range_of = lambda c: F.size(F.filter(edges, lambda e: e < c))
    sizes = {r["r"]: r["n"] for r in base.groupBy(range_of(F.col("c")).alias("r")).agg(F.count("*").alias("n")).collect()}
    deals = F.array(*[F.lit(-(-sizes.get(r, 0) // block)) for r in range(len(cuts) + 1)])  # blocks of each range
    spread = lambda m: F.pmod(F.xxhash64(F.lit(SEED), "id"), m).cast("int")
    placed = base.withColumn("r", range_of(F.col("c"))).withColumn("s", spread(F.get(deals, F.col("r")))).select("r", "s", "id", "v")

    def meet(where: DataFrame) -> DataFrame:
        """query_id, vec_id, score of queries (r, s, id, v, bound) in the blocks they go to; QUERIES a task."""
        turns = where.groupBy("r", "s").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("turns"))
        left = placed.join(turns, ["r", "s"]).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")
        right = where.join(turns, ["r", "s"]).withColumn("t", F.pmod(F.xxhash64(F.lit(SEED + 1), "id"), F.col("turns")).cast("int")).drop("turns")
        return left.groupBy("r", "s", "t").cogroup(right.groupBy("r", "s", "t")).applyInPandas(run, "query_id long, vec_id long, score double")

    def run(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(q):
            index = SortedProjections(x["id"].to_numpy(), np.stack(x["v"].to_numpy()), longest)
            for qid, at, scores in index.search(q["id"].to_numpy(), np.stack(q["v"].to_numpy()), k, q["bound"].to_numpy(float)):
                out.append(pd.DataFrame({"query_id": qid, "vec_id": index.ids[at], "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    own = asked.withColumn("r", range_of(F.col("c"))).withColumn("s", spread(F.greatest(F.get(deals, F.col("r")), F.lit(1))))
    first = stash(meet(own.select("r", "s", "id", "v", F.lit(None).cast("double").alias("bound"))), "ann-first")
    worst = first.groupBy("query_id").agg(F.count("*").alias("k"), F.min("score").alias("score")).where(F.col("k") == k)
    known = own.join(worst.select(F.col("query_id").alias("id"), "score"), "id", "left")
    square = 2 * longest**2 - 2 * longest / F.sqrt(norm2) * F.col("score")
    bound = F.when(F.col("score").isNotNull(), F.sqrt(F.greatest(square, F.lit(1e-12 * longest**2))))
    known = known.withColumn("bound", bound).withColumn("near", F.coalesce(REACH * F.col("bound"), F.lit(float("inf"))))
    to = known.withColumn("to_r", F.explode(F.sequence(range_of(F.col("c") - F.col("near")), range_of(F.col("c") + F.col("near")))))
    to = to.where(F.get(deals, F.col("to_r")) > 0).withColumn("to_s", F.explode(F.sequence(F.lit(0), F.get(deals, F.col("to_r")) - 1)))
    others = to.where((F.col("to_r") != F.col("r")) | (F.col("to_s") != F.col("s"))).select(F.col("to_r").alias("r"), F.col("to_s").alias("s"), "id", "v", "bound")
    found = first.unionByName(meet(others))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
