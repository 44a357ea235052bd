"""Language identification, word first: log frequencies of known words, else of ever shorter character n-grams.

The model is arrays: sorted 64-bit hashes of all words and n-grams of the sample, and for each the languages it was
counted in, with the log frequency there; a language's items that weren't counted share one default. So the model grows
with what was counted, and not with items times languages. A worker keeps the entries of the words it met last; words it
meets anew are looked up together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contagraph.llm.common import col, fold, fresh, short_batches, spread, stash, table

#: The fit reads about so many documents a language; that alone bounds the model.
SAMPLE = 1500
ORDERS = (4, 3, 2, 1)
#: Tables of up to so many labels are broadcast; larger ones are joined by a salted key, with the same result.
BROADCAST_LABELS, SALTS = 50_000, 64
UNKNOWN = "und"
#: A worker keeps the rows of so many words, and looks so many words of texts up at once. Neither changes a result.
CACHE, TOGETHER = 100_000, 50_000
#: Sums of so many texts times languages are held at once.
CELLS = 1_000_000
_WORDS = re.compile(r"[^\W\d_]+").findall
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def _points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n code points."""
    h = np.full(max(0, len(points) - n + 1), n, np.uint64)
    for k in range(n):
        h = (h ^ points[k : k + len(h)]) * _ODD[k]
        h ^= h >> np.uint64(29)
    return h


def _cut(padded: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of n code points that lie within one of the strings, and which one that is."""
    size = np.array([len(w) for w in padded], np.int64)
    owner, last = np.repeat(np.arange(len(padded)), size), np.repeat(np.cumsum(size), size)
    h = _gram_hashes(_points(padded), n)
    inside = np.flatnonzero(np.arange(len(h)) + n <= last[: len(h)])
    return h[inside], owner[inside]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1, ... of all spans, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class _Table:
    """Sorted keys; from starts[i] to starts[i + 1] the languages that key i was counted in, and how far its log frequency
    there lies above the language's default, that of what it wasn't counted in."""

    def __init__(self, keys: np.ndarray, langs: np.ndarray, counts: np.ndarray, languages: int) -> None:
        """A count for each key and language; pairs that occur more than once add up."""
        order = np.lexsort((langs, keys))
        keys, langs = keys[order], langs[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (langs[1:] != langs[:-1])] if len(keys) else np.zeros(0, bool)
        n = np.add.reduceat(counts[order].astype(float), np.flatnonzero(new)) if len(keys) else np.zeros(0)
        keys, self.langs = keys[new], langs[new].astype(np.int32)
        self.keys, first = np.unique(keys, return_index=True)
        self.starts = np.r_[first, len(keys)].astype(np.int64)
        total = np.bincount(self.langs, n, languages) + 0.5 * (len(self.keys) + 1)
        self.default = np.log(0.5 / total)
        self.above = (np.log((n + 0.5) / total[self.langs]) - self.default[self.langs]).astype(np.float32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys, and which of them are known."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def entries(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many entries each of these keys has, and the places of all of them."""
        sizes = self.starts[at + 1] - self.starts[at]
        return sizes, _spans(self.starts[at], sizes)


class WordFirstModel:
    """languages, and the tables of words and n-grams."""

    def __init__(self, languages: list[str], words: _Table, grams: _Table) -> None:
        self.languages, self.words, self.grams = languages, words, grams
        self.reset()

    def __reduce__(self):
        return WordFirstModel, (self.languages, self.words, self.grams)

    def reset(self) -> None:
        self.slots, self.new = _Slots(self), []
        self.kinds, self.starts = np.zeros(0, np.int8), np.zeros(1, np.int64)
        self.langs, self.values = np.zeros(0, np.int32), np.zeros(0)

    def entries(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word which default it starts from (0: none, 1: that of words, 2: that of n-grams), and what its row has above it.

        The row is the word's own if it is known, else the mean of those of its longest known n-grams. What is above the
        default comes as (word, language, value), sorted.
        """
        at, known = self.words.find(_word_hashes(words))
        kinds = known.astype(np.int8)
        sizes, places = self.words.entries(at[known])
        owners, langs, values = [np.repeat(np.flatnonzero(known), sizes)], [self.words.langs[places]], [self.words.above[places].astype(float)]
        left = np.flatnonzero(~known)
        for n in ORDERS:
            if not len(left):
                break
            h, owner = _cut([f"^{words[i]}$" for i in left], n)
            at, hit = self.grams.find(h)
            owner = owner[hit]
            count = np.bincount(owner, minlength=len(left))
            sizes, places = self.grams.entries(at[hit])
            of = np.repeat(owner, sizes)
            owners.append(left[of])
            langs.append(self.grams.langs[places])
            values.append(self.grams.above[places] / count[of])
            kinds[left[count > 0]] = 2
            left = left[count == 0]
        owner, lang, value = map(np.concatenate, (owners, langs, values))
        code, at = np.unique(owner * len(self.languages) + lang, return_inverse=True)
        return kinds, code // len(self.languages), (code % len(self.languages)).astype(np.int32), np.bincount(at, value, len(code))

    def _totals(self, texts: list[list[str]]) -> np.ndarray:
        """Sums of the words' rows; at most TOGETHER words in all. A text's sum doesn't depend on the others."""
        if len(self.slots) > CACHE:
            self.reset()
        sizes = np.array([len(t) for t in texts], np.int64)
        at = np.fromiter((self.slots[w] for t in texts for w in t), np.int64, sizes.sum())
        if self.new:
            kinds, owner, langs, values = self.entries(self.new)
            self.kinds = np.r_[self.kinds, kinds]
            self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(np.bincount(owner, minlength=len(kinds)))]
            self.langs, self.values, self.new = np.r_[self.langs, langs], np.r_[self.values, values], []
        text, n = np.repeat(np.arange(len(texts)), sizes), len(self.languages)
        out = sum(np.bincount(text[self.kinds[at] == k], minlength=len(texts))[:, None] * table.default for k, table in ((1, self.words), (2, self.grams)))
        held = self.starts[at + 1] - self.starts[at]
        places = _spans(self.starts[at], held)
        return out + np.bincount(np.repeat(text, held) * n + self.langs[places], self.values[places], len(texts) * n).reshape(len(texts), n)

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        held: list[list[str]] = []
        size = 0

        def settle() -> None:
            for words, total in zip(held, self._totals(held)):
                out.append(self._answer(total) if words else (UNKNOWN, 0.0))
            held.clear()

        for t in texts:
            words = _WORDS((t or "").lower())
            if not self.languages or not any(c.isalpha() for w in words for c in w):
                words = []
            if size + len(words) > TOGETHER or len(held) * len(self.languages) > CELLS:
                settle()
                size = 0
            if len(words) > TOGETHER:
                parts = [self._totals([words[i : i + TOGETHER]])[0] for i in range(0, len(words), TOGETHER)]
                out.append(self._answer(np.sum(parts, 0)))
                continue
            held.append(words)
            size += len(words)
        settle()
        return out

    def _answer(self, total: np.ndarray) -> tuple[str, float]:
        best = int(np.argmax(total))
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


class _Slots(dict):
    def __init__(self, model: WordFirstModel) -> None:
        self.new = model

    def __missing__(self, word: str) -> int:
        self.new.new.append(word)
        self[word] = at = len(self)
        return at


def train(labelled: DataFrame, sample: int = SAMPLE, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> WordFirstModel:
    """Fit on about `sample` documents of each language, chosen by a hash of id and text; all of them where fewer.

    Every word and n-gram of the sample is in the model, with a number for each language that it was counted in. Rows with null text or lang are
    left out. Languages are data: labels may differ in case alone or be any text. An empty table gives a model without languages, which says `und`.
    """
    rows = labelled.select(col(lang).cast("string").alias("lang"), col(text).alias("text"), F.xxhash64(col(doc_id), F.length(col(text))).alias("h")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    limits = stash(rows.groupBy("lang").agg((F.least(F.lit(1.0), sample / F.count("*")) * 1_000_000).cast("long").alias("limit")), "lang-limits")
    languages = sorted(r["lang"] for r in limits.select("lang").collect())
    if len(languages) <= BROADCAST_LABELS:
        joined = rows.join(F.broadcast(limits), "lang")
    else:  # dirty labels: the texts of a frequent one go to SALTS tasks
        salted = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.shiftright("h", 20), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    chosen = joined.where(F.pmod("h", F.lit(1_000_000)) < F.col("limit")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, found in counts.items():
                words, n = list(found), np.fromiter(found.values(), np.int64, len(found))
                cut = [_cut([f"^{w}$" for w in words], k) for k in ORDERS]
                grams, at = np.unique(np.concatenate([h for h, _ in cut]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([n[owner] for _, owner in cut]), len(grams)).astype(np.int64)
                for kind, keys, many in ((0, _word_hashes(words), n), (1, grams, sums)):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array([kind] * len(keys), pa.int32()), pa.array(keys.view(np.int64)), pa.array(many)], names=["lang", "kind", "item", "n"])
            counts.clear()

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts.setdefault(name, Counter()).update(_WORDS(t.as_py().lower()))
            if sum(map(len, counts.values())) > CACHE:
                yield from out()
        yield from out()

    # items are hashes from here on
    counted = stash(short_batches(chosen).mapInArrow(run, "lang string, kind int, item long, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "lang-counts")
    tables = []
    for kind in (0, 1):
        got = counted.where(F.col("kind") == kind).select("lang", "item", "n").toArrow().combine_chunks()
        names = got["lang"].combine_chunks().dictionary_encode() if got.num_rows else pa.array([], pa.string()).dictionary_encode()
        at = {x: i for i, x in enumerate(languages)}
        place = np.array([at[x] for x in names.dictionary.to_pylist()], np.int32)
        langs = place[names.indices.to_numpy(zero_copy_only=False)] if got.num_rows else place
        tables.append(_Table(got["item"].to_numpy().astype(np.int64).view(np.uint64), langs, got["n"].to_numpy(), len(languages)))
    return WordFirstModel(languages, *tables)


def identify(docs: DataFrame, model: WordFirstModel, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (the best language's share, 0 to 1).

    Null text and text without a letter give `und` and 0; ties go to the language first by code point. Whole texts are
    read, however long; equal texts get equal answers; an empty table stays empty. Existing columns of these names are
    kept; ours then get an underscore.
    """
    pred, sure = fresh(docs, "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, place = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        try:
            for batch in batches:
                found = [x for i in range(0, batch.num_rows, 256) for x in own.predict_all(batch.column(place).slice(i, 256).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*names, pred, sure])
        finally:
            own.reset()  # the worker may live on

    return short_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(sure, T.DoubleType())]))


def training_rows(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return docs.where(fold(col(doc_id)) != 0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = train(training_rows(docs))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
