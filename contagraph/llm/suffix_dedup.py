"""Suffix-array dedup: bytes that lie in a string of LENGTH bytes which also starts elsewhere are removed.

Suffixes are sorted only where the text itself says so. The anchor of a window of LENGTH bytes is the place, among its first
SPAN, whose 8 bytes have the least hash: equal windows have their anchors in the same place, so they can only be equal if
the suffixes at their anchors share their first CORE bytes. An anchor's context is all the bytes of its windows.

1. Cores that occur once are dropped, by a count of their hashes; most of a text goes here.
2. Contexts that occur more than once are repeated as a whole.
3. Others go to the task of their leading bytes: sampled splitters cut the suffixes at anchors into ranges. There suffixes,
   and the reversed texts before them, are sorted by multikey quicksort, with 8 bytes as a letter. The common prefixes of
   neighbours then tell for each distance to the anchor which windows are equal. A range takes all suffixes of equal leading
   bytes; where there are too many for that (HOT contexts of one core), windows are compared across all of them by a count
   of 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contagraph.llm.common import col, discard, fresh, short_batches, stash, table

LENGTH = 400
#: Places of a window that its anchor may have; the bytes from an anchor on that all of its windows hold.
SPAN = 256
#: Contexts of one core that one task sorts at most; contexts that are sorted together; starts of a text that are looked at together.
HOT, TOGETHER, PIECE = 4_096, 8_192, 1 << 20
#: Words of a passage: over 50. Words of texts that are looked at together; words whose hashes a task remembers.
PASSAGE, WORDS_TOGETHER, WORDS_KNOWN = 51, 1 << 18, 100_000
_GRAM = 8
_PLACE = np.uint64((1 << 24) - 1)


def _span(length: int) -> int:
    return max(1, min(SPAN, length - _GRAM))


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of a text, in order: runs of starts that share an anchor, as (anchor, first start, last start)."""
    span, found = _span(length), []
    for begin in range(0, len(text) - length + 1, PIECE):
        piece = text[begin : begin + PIECE + length - 1]
        n = len(piece) - length + 1
        grams = np.ndarray(n + span - 1, "<u8", piece, strides=(1,)).copy()
        grams *= np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(0xD6E8FEB86659FD93)
        # the place in the low bits: of equal hashes the first
        keys = grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64)
        least = _sliding_min(keys, span)
        at = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], n] - 1
        found.append((at[first] + begin, first + begin, last + begin))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(map(np.concatenate, zip(*found)))


def _sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """The least of each `span` neighbours: blocks of that size, minima from both of their ends."""
    n = len(x) - span + 1
    padded = np.full(-(-len(x) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, span)
    to_end = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    from_start = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(to_end[:n], from_start[span - 1 : span - 1 + n])


def multikey_order(letters: np.ndarray) -> np.ndarray:
    """The order of the rows of a matrix: by the first letter, then each run of equal ones by the next, until all are told apart."""
    order, open_ = np.arange(len(letters)), np.arange(len(letters))
    run = np.zeros(len(letters), np.int64)  # the run that a place of the order belongs to
    for d in range(letters.shape[1]):
        if len(open_) < 2:
            break
        rows = order[open_]
        inside = np.lexsort((letters[rows, d], run[open_]))
        rows = rows[inside]
        order[open_] = rows
        x = letters[rows, d]
        new = np.r_[True, (run[open_][1:] != run[open_][:-1]) | (x[1:] != x[:-1])]
        run[open_] = open_[np.flatnonzero(new)][np.cumsum(new) - 1]
        start = np.flatnonzero(new)
        long = np.diff(np.r_[start, len(open_)]) > 1
        open_ = open_[np.repeat(long, np.diff(np.r_[start, len(open_)]))]
    return order


def _bytes(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)


def _sorted(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows, and for each place of it the length of the prefix shared with the one before."""
    order = multikey_order(np.ascontiguousarray(matrix).view(">u8").astype(np.uint64))
    common = np.zeros(len(matrix), np.int64)
    for i in range(1, len(order), 4096):
        j = min(i + 4096, len(order))
        differ = matrix[order[i:j]] != matrix[order[i - 1 : j - 1]]
        common[i:j] = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
    return order, common


def repeated_distances(contexts: list[bytes], place: np.ndarray, count: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows of contexts occur in another one, as a matrix of contexts by the distance from window to anchor.

    place is the anchor's place in its context, count the number of windows, which start at 0, 1, ...
    """
    span = _span(length)
    m, wide = len(contexts), -(-length // 8) * 8
    right, after = _sorted(_bytes([c[p : p + length] for c, p in zip(contexts, place.tolist())], wide))
    left, before = _sorted(_bytes([c[:p][::-1] for c, p in zip(contexts, place.tolist())], -(-span // 8) * 8))
    least, most = place - count + 1, place
    out = np.zeros((m, span), bool)
    r, b = np.empty(m, np.int64), np.empty(m, np.int64)
    for distance in range(span):
        r[right] = np.cumsum(after < length - distance)
        b[left] = np.cumsum(before < distance)
        rows = np.flatnonzero((least <= distance) & (distance <= most))
        if len(rows) > 1:
            key = r[rows] * (m + 1) + b[rows]
            by = np.argsort(key, kind="stable")
            same = key[by][1:] == key[by][:-1]
            out[rows[by], distance] = np.r_[False, same] | np.r_[same, False]
    return out


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Sorted places as runs (first, last)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), starts[np.r_[cut, len(starts) - 1]].tolist()))


_PLACES = "core long, t1 long, t2 long, n long, doc binary, first int, anchor int, last int"


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _anchored(texts: DataFrame, length: int, cores: bool) -> DataFrame:
    """Of texts (doc, text: binary) either each core (core, n: 1 or 2 for more), or each context, by its digest, with its place.

    What a text holds more than once comes once, with n = 2; the places of the others come with n = 0.
    """
    bare = length - _span(length) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(2 if cores else 8)]
            for doc, body in zip(batch.column(0), batch.column(1)):
                view = memoryview(body.as_buffer()) if body.is_valid else b""
                if len(view) < length:
                    continue
                where = anchors(view, length)
                seen: dict = {}
                for at, first, last in zip(*(x.tolist() for x in where)):
                    core = xxhash.xxh3_64_intdigest(view[at : at + bare])
                    key = core if cores else (core, xxhash.xxh3_128_intdigest(view[first : last + length], at - first))
                    seen.setdefault(key, []).append((first, at, last))
                if cores:
                    out[0] += map(_signed, seen)
                    out[1] += [min(2, len(x)) for x in seen.values()]
                    continue
                name = doc.as_py()
                for (core, h), places in seen.items():
                    for i, place in enumerate(places):
                        n = min(2, len(places)) if i == 0 else 0
                        for column, x in zip(out, (_signed(core), _signed(h >> 64), _signed(h & (1 << 64) - 1), n, name, *place)):
                            column.append(x)
            if cores:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["core", "n"])
            else:
                types = [pa.int64()] * 4 + [pa.binary()] + [pa.int32()] * 3
                for i in range(0, max(1, len(out[0])), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000], t) for x, t in zip(out, types)], names=[f.split()[0] for f in _PLACES.split(", ")])

    return short_batches(texts).mapInArrow(run, "core long, n long" if cores else _PLACES)


_CONTEXT = "core long, lead binary, context binary, place int, first int, doc binary, weight int, hot boolean"


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """The contexts of texts (doc, text, wanted: places); of equal texts a task takes one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        types = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.bool_()]
        names = [f.split()[0] for f in _CONTEXT.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for doc, body, wanted in zip(batch.column(0), batch.column(1), batch.column(2)):
                doc = doc.as_py()
                if doc in seen:
                    continue
                seen.add(doc)
                view = memoryview(body.as_buffer())
                for w in wanted.as_py():
                    at = w["anchor"]
                    rows.append((w["core"], bytes(view[at : at + 16]), bytes(view[w["first"] : w["last"] + length]), at - w["first"], w["first"], doc, w["weight"], w["hot"]))
                    if len(rows) >= 2_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return short_batches(texts).mapInArrow(run, _CONTEXT)


_RANGE = "doc binary, first int, last int"


def _ranges(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int32()))], names=["doc", "first", "last"])


def _compared(contexts: DataFrame, length: int) -> DataFrame:
    """Runs of starts (doc, first, last) whose windows occur in another context, from ranges of suffixes in order."""

    def solve(rows: list[dict]) -> list[tuple]:
        place = np.array([r["place"] for r in rows])
        count = np.array([len(r["context"]) for r in rows]) - length + 1
        hits = repeated_distances([r["context"] for r in rows], place, count, length)
        out = []
        for r, p, hit in zip(rows, place.tolist(), hits):
            if r["weight"] == 1 and hit.any():
                starts = p - np.flatnonzero(hit)[::-1] + r["first"]
                out += [(r["doc"], a, b) for a, b in _runs(starts)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if len(rows) >= TOGETHER and r["core"] != rows[-1]["core"]:
                    yield _ranges(solve(rows))
                    rows = []
                rows.append(r)
        if rows:
            yield _ranges(solve(rows))

    ready = contexts.select("lead", "core", "context", "place", "first", "doc", "weight").repartitionByRange("lead", "core").sortWithinPartitions("lead", "core")
    return short_batches(ready).mapInArrow(run, _RANGE)


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """The same for contexts of cores that have too many: a row for each window, by its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                view = memoryview(r["context"])
                n = len(view) - length + 1
                h = [xxhash.xxh3_128_intdigest(view[i : i + length], r["place"] - i) for i in range(n)]
                columns = [pa.array([_signed(x >> 64) for x in h], pa.int64()), pa.array([_signed(x & (1 << 64) - 1) for x in h], pa.int64()), pa.array([r["doc"]] * n, pa.binary()), pa.array(range(r["first"], r["first"] + n), pa.int32()), pa.array([r["weight"]] * n, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "doc", "start", "weight"])

    windows = stash(short_batches(contexts.select("context", "place", "first", "doc", "weight")).mapInArrow(run, "h1 long, h2 long, doc binary, start int, weight int"), "suffix-windows")
    twice = stash(windows.groupBy("h1", "h2").agg(F.sum("weight").alias("n")).where(F.col("n") > 1).drop("n"), "suffix-twice")
    return windows.where(F.col("weight") == 1).join(twice, ["h1", "h2"]).select("doc", F.col("start").alias("first"), F.col("start").alias("last"))


def repeated_starts(texts: DataFrame, length: int = LENGTH, hot: int | None = None) -> DataFrame:
    """doc, spans: runs (first, last) of the starts of windows that also start elsewhere, for the docs that have any.

    texts has doc, a digest that stands for equal texts, and text, its bytes; equal texts are so many places each.
    """
    most = HOT if hot is None else hot
    long = texts.where(F.octet_length("text") >= length)
    cores = stash(_anchored(long, length, True).groupBy("core").agg(F.sum("n").alias("n")).where(F.col("n") > 1).drop("n"), "suffix-cores")
    live = stash(_anchored(long, length, False).join(cores, "core"), "suffix-live")
    kinds = live.where(F.col("n") > 0).groupBy("core", "t1", "t2").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("doc", "first", "anchor", "last")])
    kinds = stash(kinds, "suffix-kinds")
    whole = kinds.where(F.col("n") > 1).select("core", "t1", "t2")
    sure = live.drop("n").join(whole, ["core", "t1", "t2"]).select("doc", "first", "last")
    crowds = stash(kinds.groupBy("core").agg(F.count("*").alias("m"), F.min("n").alias("least")).where((F.col("m") > 1) & (F.col("least") == 1)).select("core", (F.col("m") > most).alias("hot")), "suffix-crowds")
    wanted = kinds.join(crowds, "core").select("doc", F.struct("core", "first", "anchor", "last", F.least("n", F.lit(2)).cast("int").alias("weight"), "hot").alias("w"))
    wanted = stash(wanted.groupBy("doc").agg(F.collect_list("w").alias("wanted")), "suffix-wanted")
    contexts = stash(_contexts(long.join(wanted, "doc"), length), "suffix-contexts")
    # contexts may come from several of a number of equal texts; these weigh 2 and only serve to be met
    local = _compared(contexts.where(~F.col("hot")), length)
    found = sure.unionByName(local)
    if not contexts.where("hot").isEmpty():
        found = found.unionByName(_counted(contexts.where("hot"), length))
    return stash(found.distinct().groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "suffix-spans")


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _rolled(x: np.ndarray, base: int) -> Callable[[np.ndarray, np.ndarray | int], np.ndarray]:
    """A function of starts and lengths that gives the hashes of these parts of x, wherever they lie in it."""
    inverse = pow(base, -1, 1 << 64)
    powers, back = np.full(len(x), base, np.uint64), np.full(len(x), inverse, np.uint64)
    powers[:1] = back[:1] = 1
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(x * np.cumprod(powers))]
    back = np.cumprod(back)

    def part(starts: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        h = (sums[starts + size] - sums[starts]) * back[starts]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ h >> np.uint64(32)

    return part


def _passages(texts: Iterator[tuple[int, bytes | memoryview]], words: int) -> Iterator[tuple]:
    """For texts (d, bytes), some at a time: d, core and context of each run of windows that share an anchor, the runs' first
    windows and numbers, and a function of first words that gives the windows' hashes. A window has `words` words."""
    span = max(1, min(words - words // 3, words - 1))
    bare, known = words - span + 1, _WordHashes()

    def solve(parts: list[tuple[int, np.ndarray]]) -> tuple:
        x = np.concatenate([p for _, p in parts])
        sizes = np.array([len(p) for _, p in parts])
        text = np.repeat(np.arange(len(parts)), sizes)
        cores, rest = _rolled(x, 0x9E3779B97F4A7C15), _rolled(x, 0xC2B2AE3D27D4EB4F)
        places = np.arange(len(x) - bare + 1)
        core = cores(places, bare)
        # the place in the low bits: of equal hashes the first
        at = (_sliding_min(core & ~_PLACE | places.astype(np.uint64), span) & _PLACE).astype(np.int64)
        windows = np.flatnonzero(text[: len(at)] == text[words - 1 :])
        at, of = at[windows], text[windows]
        first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (of[1:] != of[:-1])])
        count = np.diff(np.r_[first, len(windows)])
        begin = windows[first]
        name = np.array([d for d, _ in parts], np.int64)[of[first]]
        return name, core[at[first]].view(np.int64), rest(begin, count + words - 1).view(np.int64), begin, count, lambda starts: rest(starts, words).view(np.int64)

    parts: list[tuple[int, np.ndarray]] = []
    total = 0
    for d, body in texts:
        all_ = bytes(body).split()
        for i in range(0, len(all_) - words + 1, WORDS_TOGETHER):
            some = all_[i : i + WORDS_TOGETHER + words - 1]
            parts.append((d, np.fromiter(map(known.__getitem__, some), np.uint64, len(some))))
            total += len(some)
            if total >= WORDS_TOGETHER:
                yield solve(parts)
                parts, total = [], 0
    if parts:
        yield solve(parts)


def _passage_runs(texts: DataFrame, words: int) -> DataFrame:
    """Core and context of the runs of windows of texts (d, text), once where a text repeats them; of equal texts a task takes one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        rows = ((d, body.as_buffer()) for batch in batches for d, body in zip(batch.column(0).to_pylist(), batch.column(1)) if not (d in seen or seen.add(d)))
        for name, core, context, *_ in _passages(rows, words):
            columns = np.array([core, context, name])
            columns = columns[:, np.lexsort(columns)]
            columns = columns[:, np.r_[True, (columns[:, 1:] != columns[:, :-1]).any(axis=0)]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["core", "context", "d"])

    return short_batches(texts).mapInArrow(run, "core long, context long, d long")


def _passage_windows(texts: DataFrame, words: int) -> DataFrame:
    """The windows of those contexts of texts (d, text, wanted) that are wanted, by core and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # what one text wants may be taken from others of its batch too: windows are only counted
            wanted = np.unique(batch.column(2).flatten().to_numpy(zero_copy_only=False))
            rows = ((d.as_py(), body.as_buffer()) for d, body in zip(batch.column(0), batch.column(1)))
            for name, core, context, begin, count, digest in _passages(rows, words):
                some = np.isin(context, wanted)
                name, core, begin, count = name[some], core[some], begin[some], count[some]
                starts = np.repeat(begin - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum()) if len(count) else begin
                columns = np.repeat(core, count), digest(starts), np.repeat(name, count)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["core", "window", "d"])

    return short_batches(texts).mapInArrow(run, "core long, window long, d long")


def repeated_passages(texts: DataFrame, words: int = PASSAGE) -> DataFrame:
    """doc of those texts (doc, text: binary) that hold `words` words in a row which another row holds too.

    Words are what blanks (BLANKS) separate, whatever the blanks. Windows are equal if their digests and their cores' are,
    of 64 bits each. A text that shares a whole context needs no more; only for others are windows compared one by one, with
    those of all contexts of their cores.
    """
    if words < 2:
        raise ValueError("words must be above 1")

    def held(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.min("d").alias("a"), F.max("d").alias("b"))

    ids = stash(texts.groupBy("doc").agg((F.count("*") > 1).alias("copied")).withColumn("d", F.xxhash64("doc")), "passage-ids")
    keyed = texts.where(F.octet_length("text") >= 2 * words - 1).select(F.xxhash64("doc").alias("d"), "text")
    runs = stash(_passage_runs(keyed, words), "passage-runs")
    live = stash(runs.join(held(runs, "core").where("a < b").select("core"), "core"), "passage-live")
    kinds = stash(held(live, "core", "context"), "passage-kinds")
    alike = live.join(kinds.where("a < b").select("core", "context"), ["core", "context"]).select("d")
    copied = runs.select("d").distinct().join(ids.where("copied"), "d").select("d")
    sure = stash(alike.unionByName(copied).distinct(), "passage-sure")
    unsure = kinds.where("a = b").join(sure.select(F.col("d").alias("a")), "a", "left_anti").select("core").distinct()
    wanted = stash(kinds.join(unsure, "core").groupBy(F.col("a").alias("d")).agg(F.collect_list("context").alias("wanted")), "passage-wanted")
    windows = stash(_passage_windows(keyed.join(wanted, "d"), words), "passage-windows")
    met = windows.join(held(windows, "core", "window").where("a < b").select("core", "window"), ["core", "window"]).select("d")
    out = stash(ids.join(sure.unionByName(met).distinct(), "d").select("doc"), "passage-docs")
    discard(ids, runs, live, kinds, sure, wanted, windows)
    return out


def suffix_dedup(docs: DataFrame, length: int = LENGTH, text: str = "text", hot: int | None = None, passage: int | None = None) -> DataFrame:
    """docs and n_bytes, n_removed, n_spans, kept: the bytes that stay of `text` in UTF-8, as binary.

    A byte goes if it lies in a string of `length` bytes that starts anywhere else too, in another row or the same one,
    overlapping or not; matches don't cross rows. Strings are judged on the input. n_spans counts the runs removed.

    Null and empty texts have no bytes. Every row counts, repeated ones too, whatever its other columns are; equal texts
    have equal results. Texts may be of any length below 2 GB; a task holds one text and some 50 bytes for each of PIECE of
    its bytes. An empty table gives none. Existing columns are kept; ours get an underscore where names clash.

    With `passage`, a column repeats_passage follows: whether the text holds so many words in a row that another row holds too.
    It takes nothing away.
    """
    if length <= _GRAM:
        raise ValueError(f"length must be above {_GRAM}")
    names = fresh(docs, "n_bytes", "n_removed", "n_spans", "kept", "suffix_doc", "suffix_spans", "suffix_text", "repeats_passage")
    *results, doc, spans, body, flag = names
    raw = F.coalesce(col(text), F.lit("")).cast("binary")
    mark = F.unhex(F.md5(raw))
    texts = docs.select(mark.alias("doc"), raw.alias("text"))
    found = repeated_starts(texts, length, hot).select(F.col("doc").alias(doc), F.col("spans").alias(spans))
    if passage is not None:
        found = found.join(repeated_passages(texts, passage).select(F.col("doc").alias(doc), F.lit(True).alias(flag)), doc, "full")
    joined = docs.withColumn(doc, mark).withColumn(body, raw).join(found, doc, "left").drop(doc)
    others = docs.columns
    at = {c: i for i, c in enumerate(joined.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, runs, kept = [], [], [], []
            for value, ranges in zip(batch.column(at[body]), batch.column(at[spans])):
                view = memoryview(value.as_buffer())
                parts, end, n, begun = [], 0, 0, 0
                for first, last in sorted((r["first"], r["last"] + length) for r in ranges.as_py() or ()):
                    if first > end or not n:
                        parts.append(view[end:first])
                        n += 1
                        begun += last - first
                        end = last
                    elif last > end:
                        begun += last - end
                        end = last
                parts.append(view[end:])
                sizes.append(len(view))
                gone.append(begun)
                runs.append(n)
                kept.append(b"".join(parts))
            columns = [*[batch.column(at[c]) for c in others], *[pa.array(x, pa.int64()) for x in (sizes, gone, runs)], pa.array(kept, pa.binary())]
            more = [batch.column(at[flag]).fill_null(False)] if flag in at else []
            yield pa.RecordBatch.from_arrays([*columns, *more], names=[*others, *results, *[flag for _ in more]])

    ddl = ", ".join([f"`{c.replace('`', '``')}` {t}" for c, t in docs.dtypes] + [f"{c} long" for c in results[:3]] + [f"{results[3]} binary"] + [f"{flag} boolean"] * (flag in at))
    return short_batches(joined).mapInArrow(run, ddl)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), passage=PASSAGE)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "repeats_passage")
