"""Class-based bigram language model: exchange clustering assigns words to classes; transitions and emissions score.

The first reading of the texts counts every training word. The second turns each text into codes: the place of a word
among the FREQUENT most frequent, or, for rarer ones, one of SUFFIXES groups by their last bytes. All else reads codes.
Bigrams are counted over units (the CLUSTERED most frequent words, the groups, the end of a text), and the driver
clusters these by exchange. Then every other frequent word gets a class of its own: what stands before and after it is
counted by class, and it goes where that is likeliest, all of them at once in the executors. Class bigrams are counted
anew with the final classes. Every training token counts in each step; words rarer than the frequent ones have the class
of their group, and their own counts by a join with the whole table of counts.

P(w | v) = P(class w | class v) * P(unit w | class w) * P(w | unit w); the last is 1 for frequent words. Each factor is
smoothed, and each group keeps the mass of one unseen word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contagraph.llm.common import col, discard, fold, fresh, short_batches, stash, table

#: Words clustered on the driver, groups of rare words, classes, rounds of exchange, words with a class of their own.
CLUSTERED, SUFFIXES, CLASSES, ROUNDS, FREQUENT = 3000, 256, 64, 4, 150_000
_FLUSH, _LONG, _TOGETHER = 400_000, 24, 2_000_000


def tokens(text: str | None) -> list[bytes]:
    """Words of the text, A-Z lower-cased; bytes.split() splits at blank and \\x09-\\x0D exactly."""
    return (text or "").encode().lower().split()


def _key(word: bytes) -> bytes:
    return word if len(word) <= _LONG else b"\0" + hashlib.md5(word).digest()


def suffix_group(word: bytes, groups: int = SUFFIXES) -> int:
    bare = word.rstrip(b".,;:!?*#%&$") or word
    return zlib.crc32(bare[-3:]) % groups


def count_words(docs: DataFrame, groups: int = SUFFIXES) -> DataFrame:
    """key (binary), grp, c over the column `text`; counted per task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = list(counts)
            return pa.RecordBatch.from_arrays([pa.array([_key(w) for w in words], pa.binary()), pa.array([suffix_group(w, groups) for w in words], pa.int32()), pa.array(counts.values(), pa.int64())], names=["key", "grp", "c"])

        for batch in batches:
            for t in batch.column(0):
                counts.update(tokens(t.as_py()))
                if len(counts) > _FLUSH:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return short_batches(docs.select("text")).mapInArrow(run, "key binary, grp int, c long").groupBy("key", "grp").agg(F.sum("c").alias("c"))


class _Units(dict):
    """Word -> unit: the place of its key among the clustered or frequent words, else first + its suffix group."""

    def __init__(self, known: dict[bytes, int], first: int, groups: int) -> None:
        super().__init__(known)
        self.first, self.groups = first, groups

    def __missing__(self, word: bytes) -> int:
        at = self.get(_key(word)) if len(word) > _LONG else None
        return self.first + suffix_group(word, self.groups) if at is None else at


def code(docs: DataFrame, words: list[bytes], groups: int = SUFFIXES, text: str = "text", names: tuple[str, ...] = ("lm_row", "codes", "rare", "times")) -> DataFrame:
    """docs without text but with a row number, codes (unsigned 32-bit), and its words of the groups with their counts.

    To be stashed: row numbers are new at each run. A code is the place of a word in words, or their number and a group.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)
    kept = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _Units({w: i for i, w in enumerate(shared.value)}, len(shared.value), groups)
        first, row = len(shared.value), TaskContext.get().partitionId() << 40
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch, out = whole.slice(i, 1000), ([], [], [])
                for t in batch.column(batch.num_columns - 1):
                    found = tokens(t.as_py())
                    seq = np.fromiter(map(units.__getitem__, found), np.uint32, len(found))
                    rare = Counter([_key(found[i]) for i in np.flatnonzero(seq >= first)])
                    for x, y in zip(out, (seq.tobytes(), list(rare), list(rare.values()))):
                        x.append(y)
                rows = pa.array(range(row, row + batch.num_rows), pa.int64())
                row += batch.num_rows
                kinds = (pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], rows, *(pa.array(x, k) for x, k in zip(out, kinds))], names=[*kept, *names])

    schema = [f"`{c.replace('`', '``')}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    kinds = ("long", "binary", "array<binary>", "array<int>")
    return short_batches(docs.select(*map(col, kept), col(text))).mapInArrow(run, ", ".join([*schema, *(f"`{n}` {k}" for n, k in zip(names, kinds))]))


def _counted(coded: DataFrame, maps: tuple[np.ndarray, ...], cells) -> DataFrame:
    """cell, n: counts of the cells that cells(codes, *maps) gives for each text's codes; a text's last code is the end's."""
    shared = coded.sparkSession.sparkContext.broadcast(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        codes_of, counts_of, size = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def settle() -> None:
            nonlocal codes_of, counts_of, size
            new, n = np.unique(np.concatenate(held), return_counts=True)
            codes_of, at = np.unique(np.concatenate([codes_of, new]), return_inverse=True)
            counts_of = np.bincount(at, np.concatenate([counts_of, n])).astype(np.int64)
            held.clear()
            size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes_of), pa.array(counts_of)], names=["cell", "n"])

        for batch in batches:
            for t in batch.column(0):
                held.append(cells(np.frombuffer(t.as_py(), np.uint32), *shared.value))
                size += len(held[-1])
                if size > _TOGETHER:
                    settle()
                    if len(codes_of) > 4 * _FLUSH:
                        yield out()
                        codes_of, counts_of = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if held:
            settle()
        if len(codes_of):
            yield out()

    return coded.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _pairs_of(codes: np.ndarray, unit_of: np.ndarray) -> np.ndarray:
    """Cells of the bigrams of a text; the end, which unit_of has last, comes before its first word and after its last."""
    ends = len(unit_of) - 1
    m = int(unit_of.max()) + 1
    seq = unit_of[np.concatenate([[ends], codes, [ends]])]
    return seq[:-1] * m + seq[1:]


def _sides_of(codes: np.ndarray, place: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Cells (place, side, class) of what stands before (side 0) and after each word that has a place."""
    ends = len(kind) - 1
    kinds = kind[np.concatenate([[ends], codes, [ends]])]
    at = place[codes]
    own = np.flatnonzero(at >= 0)
    c = int(kind.max()) + 1
    return np.concatenate([2 * at[own] * c + kinds[own], (2 * at[own] + 1) * c + kinds[own + 2]])


def count_bigrams(docs: DataFrame, clustered: list[bytes], groups: int = SUFFIXES) -> DataFrame:
    """a, b, n over units of docs' column `text`; the end of a text is the last unit, and comes before its first word."""
    units = np.arange(len(clustered) + groups + 1)
    counted = _counted(code(docs.select("text"), clustered, groups).select("codes"), (units,), _pairs_of)
    return counted.select(F.floor(F.col("cell") / len(units)).cast("int").alias("a"), (F.col("cell") % len(units)).cast("int").alias("b"), "n")


def likeliest_classes(coded: DataFrame, place: np.ndarray, kind: np.ndarray, chain: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """A class for each place: the one that makes the word and its neighbours likeliest, the neighbours' classes fixed.

    place: of each code, or -1; kind: the class of each code; chain: log probabilities of class after class; mass: each
    class's tokens. Class 0 is the end's and no word's; words that never occur get class 1.
    """
    n, c = int(place.max(initial=-1)) + 1, len(mass)
    out = np.full(n, min(1, c - 1), np.int64)
    if not n or c < 2:
        return out
    counted = _counted(coded.select("codes"), (place, kind), _sides_of)
    sides = counted.select(F.floor(F.col("cell") / (2 * c)).cast("int").alias("w"), (F.col("cell") % (2 * c)).cast("int").alias("side"), "n")
    shared = coded.sparkSession.sparkContext.broadcast((chain, np.log10(mass + 0.5)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, size = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                at = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
                near = np.zeros((batch.num_rows, 2 * c))
                flat = batch.column(1).flatten()
                near[at, flat.field(0).to_numpy()] = flat.field(1).to_numpy()
                gain = near[:, :c] @ steps + near[:, c:] @ steps.T - near[:, :c].sum(1, keepdims=True) * size
                gain[:, 0] = -np.inf
                best = np.argmax(np.round(gain, 6), 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32())], names=["w", "cls"])

    got = sides.groupBy("w").agg(F.collect_list(F.struct("side", "n")).alias("near")).mapInArrow(run, "w int, cls int").toArrow()
    out[got["w"].to_numpy()] = got["cls"].to_numpy()
    return out


def exchange_clusters(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """A class for each unit of a square table of bigram counts.

    Units start in classes by frequency rank; then each in turn goes to the class that raises the likelihood of the
    class bigrams most, until a round moves none. The last unit (the end of a text) stays alone in class 0.
    """
    m = len(bigrams)
    n = np.maximum(bigrams.sum(0), bigrams.sum(1))
    order = np.argsort(-n[:-1], kind="stable")
    cls = np.zeros(m, np.int64)
    if m == 1 or classes < 2:
        return cls
    cls[order] = 1 + np.arange(m - 1) % (classes - 1)
    one = np.zeros((m, classes), np.float32)
    one[np.arange(m), cls] = 1
    to, back = (bigrams @ one).astype(float), (bigrams.T @ one).astype(float)  # counts to and from each class
    table = one.T.astype(float) @ to

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    diag = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for w in order:
            if not n[w]:
                continue
            a, s = cls[w], bigrams[w, w]
            r, b = to[w].copy(), back[w].copy()
            r[a] -= s
            b[a] -= s
            table[a] -= r
            table[:, a] -= b
            table[a, a] -= s
            # the classes' own sums hold what precedes and follows w, whichever class it joins
            left, right, nl, nr = table.sum(1) + b, table.sum(0) + r, r.sum() + s, b.sum() + s
            base = f(table)
            rows = (f(table + r) - base).sum(1) - (f(table[diag, diag] + r) - base[diag, diag])
            cols = (f(table + b[:, None]) - base).sum(0) - (f(table[diag, diag] + b) - base[diag, diag])
            gain = rows + cols + f(table[diag, diag] + r + b + s) - base[diag, diag] - (f(left + nl) - f(left)) - (f(right + nr) - f(right))
            gain[0] = -np.inf
            d = int(np.argmax(gain))
            if gain[d] <= gain[a] + 1e-9:
                d = a
            table[d] += r
            table[:, d] += b
            table[d, d] += s
            if d != a:
                cls[w] = d
                moved += 1
                to[:, a] -= bigrams[:, w]
                to[:, d] += bigrams[:, w]
                back[:, a] -= bigrams[w]
                back[:, d] += bigrams[w]
        if not moved:
            break
    return cls


@dataclass
class ClassModel:
    """What scoring needs besides the counts of rare words. Arrays are by code: frequent words, then groups, then end."""

    words: list[bytes]
    groups: int
    n: int
    v: int
    base: np.ndarray
    emit: np.ndarray
    cls: np.ndarray
    step: np.ndarray
    seen: np.ndarray


def vocabulary(counts: DataFrame, frequent: int = FREQUENT) -> list[tuple[int, bytes, int]]:
    """(-count, key, group) of the most frequent words, at most `frequent`, most frequent first, ties by key; all of a count or none."""
    # the least count that at most `frequent` words reach, from a histogram of under 1,100 rows
    step = F.floor(F.log2("c") * 16)
    room, floor_c = frequent, None
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("k"), F.min("c").alias("least")).collect(), key=lambda r: -r["s"]):
        if r["k"] > room:
            break
        room, floor_c = room - r["k"], r["least"]
    if floor_c is None:
        return []
    got = counts.where(F.col("c") >= floor_c).select("key", "grp", "c").toArrow()
    return sorted(zip((-got["c"].to_numpy()).tolist(), got["key"].to_pylist(), got["grp"].to_pylist()))


def _chain(trans: np.ndarray) -> np.ndarray:
    """log10 P(class | class before), backed off to the classes' own shares."""
    c, into = len(trans), trans.sum(0)
    own = (into + 0.5) / (into.sum() + 0.5 * c)
    mu = (trans > 0).sum(1, keepdims=True) + 1.0
    return np.log10((trans + mu * own) / (trans.sum(1, keepdims=True) + mu))


def _matrix(counted: DataFrame, m: int, kind: type) -> np.ndarray:
    out = np.zeros(m * m, kind)
    got = counted.toArrow()
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(m, m)


def fit(coded: DataFrame, counts: DataFrame, top: list[tuple[int, bytes, int]], clustered: int = CLUSTERED, groups: int = SUFFIXES, classes: int = CLASSES) -> ClassModel:
    """The model of training texts that code() made with the words of top; counts has those of all words."""
    n_docs, f = coded.count(), len(top)
    n_g, v_g = np.zeros(groups), np.zeros(groups)
    for r in counts.groupBy("grp").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        n_g[r["grp"]], v_g[r["grp"]] = r["n"], r["v"]
    n, v = int(n_g.sum()) + n_docs, int(v_g.sum()) + (n_docs > 0)
    grp = np.array([g for _, _, g in top], np.int64)
    k = min(clustered, f)
    # code -> unit of the exchange: clustered words, groups, end
    unit = np.concatenate([np.arange(k), k + grp[k:], k + np.arange(groups), [k + groups]]).astype(np.int64)
    big = _matrix(_counted(coded.select("codes"), (unit,), _pairs_of), k + groups + 1, np.float32)
    cls = exchange_clusters(big, min(classes, len(big)))
    c = int(cls.max()) + 1
    one = np.zeros((len(big), c), np.float32)
    one[np.arange(len(big)), cls] = 1
    trans = (one.T @ (big @ one)).astype(float)
    del big
    kind = cls[unit]
    if f > k:
        place = np.full(f + groups, -1, np.int64)
        place[k:f] = np.arange(f - k)
        kind[k:f] = likeliest_classes(coded, place, kind, _chain(trans), trans.sum(0))
        trans = _matrix(_counted(coded.select("codes"), (kind,), _pairs_of), c, float)
    # units now: frequent words, each its own, groups of all others, end
    have = np.array([-x for x, _, _ in top], float)
    n_g -= np.bincount(grp, have, groups)
    v_g -= np.bincount(grp, minlength=groups)
    unit_n, into = np.concatenate([have, n_g, [n_docs]]), trans.sum(0)
    emit = np.log10((unit_n + 0.5) / (into[kind] + 0.5 * np.bincount(kind, minlength=c)[kind]))
    emit[f:-1] -= np.log10(n_g + 0.5 * (v_g + 1))
    base = np.log10(np.concatenate([have + 0.5, np.ones(groups), [n_docs + 0.5]])) - np.log10(n + 0.5 * (v + 1))
    seen = np.concatenate([np.ones(f), np.zeros(groups), [n_docs > 0]])
    return ClassModel([w for _, w, _ in top], groups, n, v, base, emit, kind, _chain(trans), seen)


def train(docs: DataFrame, clustered: int = CLUSTERED, groups: int = SUFFIXES, classes: int = CLASSES, frequent: int = FREQUENT) -> tuple[ClassModel, DataFrame]:
    """The model of docs' column `text`, and the stashed table of all word counts.

    Null text is an empty one: its end alone. Rows count as often as they occur. An empty table gives a model without
    words, by which all words are equally unseen. Texts and words may be of any length; extra columns don't matter.
    """
    counts = stash(count_words(docs, groups), "lm-counts")
    top = vocabulary(counts, frequent)
    coded = stash(code(docs.select("text"), [w for _, w, _ in top], groups).select("codes"), "lm-codes")
    model = fit(coded, counts, top, clustered, groups, classes)
    discard(coded)
    return model, counts


def score(docs: DataFrame, model: ClassModel, counts: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs, n_tokens, n_known, base_score and score of every row. Null text is an empty text: its end alone.

    Rows that repeat get equal scores each; an empty table gives no row; kept columns may have any names but our four.
    """
    picked = docs.select(*map(col, keep), col(text).alias(own := fresh(docs.select(*map(col, keep)), "text")[0]))
    names = tuple(fresh(picked, "lm_row", "codes", "rare", "times"))
    return score_coded(stash(code(picked, model.words, model.groups, own, names), "lm-parts"), model, counts, keep, names)


def score_coded(coded: DataFrame, model: ClassModel, counts: DataFrame, keep: tuple[str, ...], names: tuple[str, ...] = ("lm_row", "codes", "rare", "times")) -> DataFrame:
    """score() of stashed texts that code() made with the model's words."""
    row, codes, rare, times = names
    shared = coded.sparkSession.sparkContext.broadcast((model.base, model.emit, model.cls, model.step, model.seen))
    *own, extra, known = fresh(coded, "n_tokens", "n_known", "base_score", "score", "more", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, emit, cls, step, seen = shared.value
        end = len(cls) - 1
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for t in batch.column(batch.num_columns - 1):
                seq = np.append(np.frombuffer(t.as_py(), np.uint32), np.uint32(end))
                kinds = cls[seq]
                before = np.concatenate([[cls[end]], kinds[:-1]])
                for x, y in zip(out, (len(seq), int(seen[seq].sum()), float(base[seq].sum()), float(emit[seq].sum() + step[before, kinds].sum()))):
                    x.append(y)
            kinds_of = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, k) for x, k in zip(out, kinds_of))], names=[*keep, row, *own])

    schema = [f"`{c.replace('`', '``')}` {coded.schema[c].dataType.simpleString()}" for c in keep]
    part = coded.select(*map(col, keep), row, codes).mapInArrow(run, ", ".join([*schema, f"`{row}` long", *(f"`{n}` {k}" for n, k in zip(own, ("long", "long", "double", "double")))]))
    each = coded.select(row, F.explode(F.arrays_zip(F.col(rare).alias("key"), F.col(times).alias("times"))).alias("x")).select(row, "x.key", "x.times")
    found = each.join(counts.select("key", "c"), "key", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    per = found.groupBy(row).agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias(extra), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias(known))
    both, more = part.join(per, row, "left"), F.coalesce(extra, F.lit(0.0))
    n_tokens, n_known, base_score, total = own
    return both.select(*map(col, keep), F.col(n_tokens).alias("n_tokens"), (F.col(n_known) + F.coalesce(known, F.lit(0))).alias("n_known"), (F.col(base_score) + more).alias("base_score"), (F.col(total) + more).alias("score"))


def train_and_score(docs: DataFrame, training: Column, keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, ClassModel]:
    """score() of all of docs by the model of those where training holds; every text is turned into codes once."""
    names = fresh(docs.select(*map(col, keep)), "lm_row", "codes", "rare", "times", "lm_training", "text")
    picked = docs.select(*map(col, keep), training.alias(names[4]), col("text").alias(names[5]))
    counts = stash(count_words(docs.where(training)), "lm-counts")
    top = vocabulary(counts)
    coded = stash(code(picked, [w for _, w, _ in top], text=names[5], names=tuple(names[:4])), "lm-codes")
    model = fit(coded.where(F.col(names[4])).select(F.col(names[1]).alias("codes")), counts, top)
    return score_coded(coded, model, counts, keep, tuple(names[:4])), model


def op1_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, model = train_and_score(docs, fold(F.col("doc_id")) != 1)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
