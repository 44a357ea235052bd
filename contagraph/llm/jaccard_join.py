"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with equal sets of word n-grams are one class from the start, and one of them stands for all. Candidates share a
band of MinHash values. Their values are compared STEP at a time; a pair goes when the posterior probability that its
similarity reaches the threshold falls below TOLERANCE. All others are verified exactly on their n-gram sets.

No bucket is expanded into all its pairs. First each member of a bucket of the FIRST bands meets its smallest member;
the most promising such link of each text is verified, and classes form. In all bands, buckets then hold classes and no
longer single texts: those of several classes have one member of each meet one of the smallest. In buckets that still
stay apart, members of different classes are compared, block by block inside a task, which prunes, verifies and passes
on links only.
Links inside a class are then counted exactly from n-gram sets, in blocks of classes.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contagraph.llm.common import col, discard, fresh, in_order, short_batches, stash, table
from contagraph.llm.components import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP, TOLERANCE = 24, 4, 16, 1e-6
FIRST, BLOCK, SMALL_IDS, CACHE = 3, 512, 1_000_000, 200_000
_HASHES = BANDS * ROWS
_TOKENS = re.compile(r"\w+").findall
_MULTIPLY, _ADD = np.random.default_rng(4).integers(1, 2**63, (2, _HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(text: str | None, words: _Hashes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of n words (letters, digits, _; lower case); of all words where fewer; none for no words."""
    found = _TOKENS((text or "").lower())
    w = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = min(n, len(w))
    if not n:
        return w
    h = np.zeros(len(w) - n + 1, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - n + 1 + j]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ h >> np.uint64(29))


def minhash(h: np.ndarray) -> np.ndarray:
    out = np.full(_HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(h), 1024):
        out = np.minimum(out, ((h[i : i + 1024, None] * _MULTIPLY + _ADD) >> np.uint64(32)).astype(np.uint32).min(0))
    return out


def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """n -> the least number of n equal values at which P(similarity >= threshold) is still tolerance, from a flat prior."""
    out = {}
    for n in range(STEP, _HASHES + 1, STEP):
        tail = 0.0
        for m in range(n + 1):  # posterior Beta(m+1, n-m+1): P(s >= t) = P(Bin(n+1, t) <= m)
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


def survivors(x: np.ndarray, y: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of x and y (signatures) stay, and their number of equal values; pruned after each STEP values."""
    left, hits = np.arange(len(x)), np.zeros(len(x), np.int64)
    for n, m in least.items():
        hits[left] += (x[left, n - STEP : n] == y[left, n - STEP : n]).sum(1)
        left = left[hits[left] >= m]
    return left, hits[left]


def _mark(text: str) -> Column:
    """16 bytes that stand for a text; none for null."""
    return F.coalesce(F.unhex(F.md5(col(text).cast("binary"))), F.lit(b""))


def sign(docs: DataFrame, text: str, doc_id: str, marks: bool = False) -> DataFrame:
    """uid, doc_id, digest (of the n-gram set; null without words), n, sig, mark if asked for. To be stashed: uid is new at each run."""
    more = ["mark"] if marks else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, uid = _Hashes(), TaskContext.get().partitionId() << 36
        for batch in batches:
            digest, size, sig = [], [], []
            for t in batch.column(1):
                h = shingles(t.as_py(), words)
                digest.append(hashlib.md5(h.tobytes()).digest() if len(h) else None)
                size.append(len(h))
                sig.append(minhash(h).tobytes() if len(h) else None)
            uids = pa.array(range(uid, uid + len(size)), pa.int64())
            uid += len(size)
            yield pa.RecordBatch.from_arrays([uids, batch.column(0), pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.array(sig, pa.binary()), *batch.columns[2:]], names=["uid", "doc_id", "digest", "n", "sig", *more])

    picked = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"), *(_mark(text).alias(m) for m in more))
    return short_batches(picked).mapInArrow(run, ", ".join(["uid long, doc_id long, digest binary, n int, sig binary", *(f"{m} binary" for m in more)]))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, _HASHES)


def prune(pairs: DataFrame, reps: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """a, b, hits: the pairs (a, b) that Bayesian pruning leaves."""
    least = fewest_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, hits = survivors(_matrix(batch.column(2).to_pylist()), _matrix(batch.column(3).to_pylist()), least)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(hits)], names=["a", "b", "hits"])

    signed = pairs.join(reps.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b").join(reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
    return signed.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, hits long")


def sets_of(docs: DataFrame, needed: DataFrame, reps: DataFrame, text: str, doc_id: str) -> DataFrame:
    """rep, h (binary: n-gram hashes) for the reps in needed, from a second reading of their documents alone."""
    chosen = reps.join(needed, "rep").select("rep", "digest", "doc_id")
    ids = chosen.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("want")).distinct()
    read = docs.select(F.coalesce(col(doc_id).cast("long"), F.lit(-(2**63))).alias("want"), col(text).alias("text"))
    few = read.join(F.broadcast(ids) if ids.count() <= SMALL_IDS else ids, "want", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Hashes()
        for batch in batches:
            found = [x for t in batch.column(0) if len(x := shingles(t.as_py(), words))]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(x.tobytes()).digest() for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], names=["digest", "h"])

    found = short_batches(few).mapInArrow(run, "digest binary, h binary").join(chosen.select("digest", "rep"), "digest")
    return found.groupBy("rep").agg(F.min("h").alias("h"))


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b of the pairs whose n-gram sets are that similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= threshold * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], names=["a", "b"])

    both = pairs.select("a", "b").join(sets.select(F.col("rep").alias("b"), F.col("h").alias("h_b")), "b").join(sets.select(F.col("rep").alias("a"), F.col("h").alias("h_a")), "a")
    return both.select("a", "b", "h_a", "h_b").mapInArrow(run, "a long, b long")


def across(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """a, b: links among members (band, key, rep, label, sig, h, count) of one bucket with different labels; blocks meet in pairs.

    A pair is handled in the first band in which it agrees: pruned there by its MinHash values, then verified on its sets.
    """
    least = fewest_matches(threshold, tolerance)
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    placed = members.withColumn("i", F.pmod(F.xxhash64(F.lit(3), "rep"), blocks).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tiles = placed.select("band", "key", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "rep", "label", "sig", "h")

    def run(x: pd.DataFrame) -> pd.DataFrame:
        sig, rep, label, band = _matrix(x["sig"]), x["rep"].to_numpy(), x["label"].to_numpy(), int(x["band"].iloc[0])
        sets = [np.frombuffer(h, np.uint64) for h in x["h"]]
        size = np.array([len(s) for s in sets], np.int64)
        earlier = np.zeros((len(sig), band), np.uint64)
        for r in range(ROWS):
            earlier = earlier * np.uint64(0x9E3779B97F4A7C15) + sig[:, r : ROWS * band : ROWS]
        p, q = np.flatnonzero(x["i"] == x["p"]), np.flatnonzero(x["i"] == x["q"])
        same, out = x["p"].iloc[0] == x["q"].iloc[0], []
        for k, i in enumerate(p):
            to = q[k + 1 :] if same else q
            to = to[(label[to] != label[i]) & (np.minimum(size[to], size[i]) >= threshold * np.maximum(size[to], size[i]))]
            to = to[~(earlier[to] == earlier[i]).any(1)]
            if len(to):
                to = to[survivors(np.broadcast_to(sig[i], (len(to), _HASHES)), sig[to], least)[0]]
            if len(to):
                other = np.concatenate([sets[t] for t in to])
                at = np.minimum(np.searchsorted(sets[i], other), size[i] - 1)
                both = np.add.reduceat(sets[i][at] == other, np.concatenate([[0], np.cumsum(size[to])[:-1]]), dtype=np.int64)
                other = rep[to[both >= threshold * (size[to] + size[i] - both)]]
                out.append(np.stack([np.minimum(rep[i], other), np.maximum(rep[i], other)], 1))
        return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 2), np.int64), columns=["a", "b"])

    return tiles.groupBy("band", "key", "p", "q").applyInPandas(run, "a long, b long")


def count_links(members: DataFrame, threshold: float) -> DataFrame:
    """rep, links: of members (label, rep, h, count) of one class, the others that similar; exact, in pairs of blocks."""
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    placed = members.withColumn("i", F.pmod(F.xxhash64(F.lit(5), "rep"), blocks).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tiles = placed.select("label", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "rep", "h")

    def run(x: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(h, np.uint64) for h in x["h"]]
        size = np.array([len(s) for s in sets], np.int64)
        every, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(at, kind="stable")
        owner, n = owner[order], np.bincount(at, minlength=len(every))
        both = np.zeros((len(sets), len(sets)), np.float32)
        starts = np.concatenate([[0], np.cumsum(n)])
        heavy = np.flatnonzero(n > 24)
        for c in range(0, len(heavy), 2048):
            one = np.zeros((len(sets), min(2048, len(heavy) - c)), np.float32)
            for k, h in enumerate(heavy[c : c + 2048]):
                one[owner[starts[h] : starts[h + 1]], k] = 1
            both += one @ one.T
        light = np.flatnonzero((n > 1) & (n <= 24))
        for m in np.unique(n[light]):
            own = owner[starts[light[n[light] == m]][:, None] + np.arange(m)]
            np.add.at(both, (np.repeat(own, m, 1).ravel(), np.tile(own, (1, m)).ravel()), 1)
        link = both >= threshold * (size[:, None] + size[None, :] - both)
        np.fill_diagonal(link, False)
        p, q = (x["i"] == x["p"]).to_numpy(), (x["i"] == x["q"]).to_numpy()
        links = link.sum(1) if x["p"].iloc[0] == x["q"].iloc[0] else np.where(p, link[:, q].sum(1), link[:, p].sum(1))
        return pd.DataFrame({"rep": x["rep"], "links": links.astype(np.int64)})

    return tiles.groupBy("label", "p", "q").applyInPandas(run, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def _banded(bands: int) -> Column:
    """band, key: a row for each of the first bands of sig."""
    return F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 1 + 4 * ROWS * i, 4 * ROWS)) for i in range(bands)])).alias("band", "key")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()


def _with_sets(sets: DataFrame, wanted: DataFrame, docs: DataFrame, reps: DataFrame, text: str, doc_id: str, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """sets with those of the wanted reps that it lacks."""
    lacking = keep(wanted.join(sets.select("rep"), "rep", "left_anti"), "join-wanted")
    return sets if lacking.isEmpty() else sets.unionByName(keep(sets_of(docs, lacking, reps, text, doc_id), "join-sets"))


def similar(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, text: str = "text", doc_id: str = "doc_id", links: bool = True, marks: bool = False) -> DataFrame:
    """uid, doc_id, class_id, n_copies, n_links, stays, and mark (of the text) if asked for: one row for each row of docs.

    class_id is the smallest doc_id linked to it directly or through others (its own, if none); n_copies the rows with
    the same n-gram set, itself included; n_links the different texts of similarity >= threshold; stays is true for one
    row a class, that of the smallest id. Texts without words are in no class but their own and always stay; so do
    null texts. Null ids join classes but name them only where no other does. Repeated rows are copies. An empty table
    gives none; texts of any length are compared whole; other columns aren't read, whatever their names.
    """
    used: list[DataFrame] = []  # scratch tables, deleted when the last is written

    def keep(df: DataFrame, name: str) -> DataFrame:
        used.append(stash(df, name))
        return used[-1]

    def classes(edges: DataFrame) -> DataFrame:
        used.append(components(edges))
        return used[-1]

    rows = keep(sign(docs, text, doc_id, marks), "join-rows")
    more = ["mark"] if marks else []
    reps = keep(rows.where("n > 0").groupBy("digest").agg(F.min("uid").alias("rep"), F.min_by("doc_id", "uid").alias("doc_id"), F.min("sig").alias("sig"), F.count("*").alias("copies")), "join-reps")
    first = reps.select("rep", _banded(FIRST))
    # the smaller side of a join is written first, so that adaptive execution can split a large bucket or class
    hubs = keep(first.groupBy("band", "key").agg(F.min("rep").alias("hub"), F.count("*").alias("count")).where("count > 1"), "join-hubs")
    stars = first.join(hubs, ["band", "key"]).where("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    best = keep(prune(stars, reps, threshold, tolerance).groupBy("b").agg(F.max_by("a", F.struct("hits", -F.col("a"))).alias("a")).select("a", "b"), "join-best")
    sets = keep(sets_of(docs, _ends(best), reps, text, doc_id), "join-sets")
    sure = keep(verify(best, sets, threshold), "join-sure")
    labels = classes(sure)

    tagged = reps.select("rep", "sig").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("solo", F.col("label").isNull()).withColumn("label", F.coalesce("label", "rep"))
    groups = tagged.select("rep", "label", "solo", _banded(BANDS)).groupBy("band", "key", "label").agg(F.min("rep").alias("rep"), F.first("solo").alias("solo"), F.count("*").alias("n"))
    mixed = groups.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("rep", "label").alias("hub"), F.sum("n").alias("count"), F.min("solo").alias("solos")).where("low < high")
    inside = keep(groups.select("band", "key", "label", "rep").join(mixed, ["band", "key"]), "join-groups")
    near = prune(inside.where("label <> low").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), reps, threshold, tolerance)
    of = labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
    to = labels.select(F.col("node").alias("a"), F.col("label").alias("x"))
    named = near.join(of, "b", "left").join(to, "a", "left").select("a", "b", "hits", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    best = keep(named.groupBy("x", "y").agg(F.max_by(F.struct("a", "b"), F.struct("hits", -F.col("a"), -F.col("b"))).alias("e")).select("e.*"), "join-best")
    sets = _with_sets(sets, _ends(best), docs, reps, text, doc_id, keep)
    sure = sure.unionByName(keep(verify(best, sets, threshold), "join-more"))
    labels = classes(sure)

    now = labels.select(F.col("node").alias("label"), F.col("label").alias("new"))
    apart = inside.where("count > 2 or not solos").join(now, "label", "left").withColumn("new", F.coalesce("new", "label")).groupBy("band", "key").agg(F.min("new").alias("low"), F.max("new").alias("high"), F.first("count").alias("count")).where("low < high").select("band", "key", "count")
    apart = keep(apart, "join-apart")
    rest = keep(reps.select("rep", _banded(BANDS)).join(apart, ["band", "key"]), "join-rest")
    sets = _with_sets(sets, rest.select("rep").distinct(), docs, reps, text, doc_id, keep)
    rest = rest.join(reps.select("rep", "sig").join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(sets, "rep"), "rep").withColumn("label", F.coalesce("label", "rep"))
    found = keep(across(rest, threshold, tolerance), "join-across")
    if not found.isEmpty():
        sure = sure.unionByName(found)
        labels = classes(sure)
    sized = labels.join(keep(labels.groupBy("label").agg(F.count("*").alias("count")), "join-sizes"), "label")
    if links:
        counted = count_links(sized.where("count > 2").withColumnRenamed("node", "rep").join(sets, "rep"), threshold)
        sized = sized.join(counted, F.col("rep") == F.col("node"), "left").select("node", "label", F.coalesce("links", F.lit(1)).alias("links"))
    else:
        sized = sized.withColumn("links", F.lit(None).cast("long"))
    known = reps.select("digest", "rep", "copies").join(sized, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("label", "rep").alias("label"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    all_rows = stash(rows.select("uid", "doc_id", "digest", *more).join(known, "digest", "left").withColumn("label", F.coalesce("label", "uid")), "join-all")
    first = stash(all_rows.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min_by("uid", F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("first")), "join-first")
    discard(*used)
    return all_rows.join(first, "label").select("uid", "doc_id", "class_id", F.coalesce("copies", F.lit(1)).alias("n_copies"), F.coalesce("links", F.lit(0)).alias("n_links"), (F.col("uid") == F.col("first")).alias("stays"), *more)


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without all but the row of each class that stays.

    Rows are found again by id and text; of those that repeat both, the one stays whose other columns, as text and in
    their order, come first, null before all. An empty table stays empty; texts may be of any length; existing columns
    are kept, whatever their names.
    """
    kept_id, mark, gone_id, gone_mark, want = fresh(docs, "kept_id", "kept_mark", "gone_id", "gone_mark", "want")
    rows = similar(docs, text=text, doc_id=doc_id, links=False, marks=True).groupBy("doc_id", "mark").agg(F.count("*").alias("all"), F.count_if("stays").alias("want"))
    gone = stash(rows.where("want < all").select(F.col("doc_id").alias(gone_id), F.col("mark").alias(gone_mark), F.col("want").alias(want)), "join-gone")
    mine = docs.withColumn(kept_id, col(doc_id).cast("long")).withColumn(mark, _mark(text))
    same = F.col(kept_id).eqNullSafe(F.col(gone_id)) & (F.col(mark) == F.col(gone_mark))
    order = in_order(docs, doc_id, text)
    least = F.min_by(F.struct(*map(col, docs.columns)), order) if order is not None else F.first(F.struct(*map(col, docs.columns)))
    once = mine.join(gone.where(F.col(want) > 0), same, "left_semi").groupBy(kept_id, mark).agg(least.alias("row")).select("row.*")
    return mine.join(gone, same, "left_anti").select(*map(col, docs.columns)).unionByName(once)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_copies", "n_links")
