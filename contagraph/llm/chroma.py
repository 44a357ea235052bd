"""Chroma audio fingerprints: integral-image filters over pitch-class frames, offset histograms and bit errors.

A recording (WAV bytes) becomes frames of 12 pitch-class energies. Sixteen filters compare the energy of two parts of a
window of frames, in constant time from an integral image, and give two bits each: one 32-bit integer a frame.
Recordings align where their integers agree most often at one offset and few bits differ along the overlap.

Recordings of equal integers are one from the start. All others are compared, in pairs of blocks: a task finds the pairs
that have RUNS equal integers at one offset from its sorted integers, aligns each, and passes on its links, as many as
hold its classes together, and their number for each recording.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contagraph.llm.common import col, stash, table
from contagraph.llm.components import components

#: Samples of a frame and a hop at a rate of BASE; at other rates they are as long in seconds.
FRAME, HOP, SPAN, BASE = 512, 128, 12, 2000
#: Two recordings match if they share RUNS integers at one offset, overlap by OVERLAP integers, and differ in at most ERRORS of the bits.
RUNS, OVERLAP, ERRORS, KEY = 3, 16, 0.15, 1
#: A block holds about so many recordings or integers at most; a task counts so many equal integers at once.
BLOCK, INTEGERS, EXPAND = 6000, 400_000, 1_000_000
#: The integer of a window without sound: it says nothing of where recordings align, nor how well.
SILENT = 0x55555555
_LIMITS = (-0.25, 0.0, 0.25)
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def _filters() -> list[tuple[int, int, int, int]]:
    """kind, first pitch class, height, width: kinds halve a window across, along, in quarters, or in three bands."""
    return [(i % 4, (5 * i) % 12, 2 + 2 * (i % 3), SPAN - 4 * (i % 2)) for i in range(16)]


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Pitch-class energies of each frame, scaled to length one; silence stays zero. Frames and hops last as long at any rate."""
    size = round(FRAME * rate / BASE)
    if len(samples) < size or not size:
        return np.zeros((0, 12))
    starts = np.round(np.arange((len(samples) - size) * BASE // (HOP * rate) + 1) * (HOP * rate / BASE)).astype(np.int64)
    starts = starts[starts <= len(samples) - size]
    freq = np.arange(size // 2 + 1) * (BASE / FRAME)
    used = (freq >= 55) & (freq <= 4000)
    fold = np.zeros((len(freq), 12))
    fold[np.flatnonzero(used), np.round(12 * np.log2(freq[used] / 440)).astype(int) % 12] = 1
    views, window, step = np.lib.stride_tricks.sliding_window_view(samples, size), np.hanning(size), max(1, 2_000_000 // size)
    out = np.concatenate([np.abs(np.fft.rfft(views[starts[i : i + step]] * window, axis=1)) ** 2 @ fold for i in range(0, len(starts), step)])
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 1e-9, out / np.maximum(norm, 1e-9), 0)


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """One unsigned 32-bit integer for each window of SPAN frames."""
    c = chroma(samples, rate)
    n = len(c) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(c) + 1, 25))
    image[1:, 1:] = np.cumsum(np.cumsum(np.hstack([c, c]), 0), 1)  # pitch classes wrap around
    t = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[t + t1, p1] - image[t + t0, p1] - image[t + t1, p0] + image[t + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, p, h, w in _filters():
        whole = area(0, w, p, p + h)
        if kind == 0:
            a = area(0, w // 2, p, p + h)
        elif kind == 1:
            a = area(0, w, p, p + h // 2)
        elif kind == 2:
            a = area(0, w // 2, p, p + h // 2) + area(w // 2, w, p + h // 2, p + h)
        else:
            a = area(w // 4, 3 * w // 4, p, p + h)
        level = np.log((1 + a) / (1 + whole - a))
        out = out << np.uint32(2) | _GRAY[np.searchsorted(_LIMITS, level)]
    return out


def samples_of(audio: bytes | None) -> tuple[np.ndarray, int]:
    """Samples in -1..1 and rate of 16-bit WAV bytes, channels averaged; nothing for null or unreadable bytes."""
    try:
        with wave.open(io.BytesIO(audio or b"")) as w:
            if w.getsampwidth() != 2:
                return np.zeros(0), 1
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(float) / 32768
            return x.reshape(-1, w.getnchannels()).mean(1), w.getframerate()
    except (wave.Error, EOFError):
        return np.zeros(0), 1


def align(x: np.ndarray, y: np.ndarray) -> tuple[int, int, float]:
    """Best offset of y in x from the histogram of offsets of equal integers, its count, and the share of differing bits.

    Windows without sound give no offset; where both are silent they count neither as overlap nor as equal bits.
    """
    values, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    order = np.argsort(at[: len(x)], kind="stable")
    starts = np.searchsorted(at[: len(x)][order], np.arange(len(values) + 1))
    offsets = [order[starts[v] : starts[v + 1]] - j for j, v in enumerate(at[len(x) :]) if values[v] != SILENT]
    offsets = np.concatenate(offsets) if offsets else np.zeros(0, np.int64)
    if not len(offsets):
        return 0, 0, 1.0
    counts = np.bincount(offsets + len(y))
    best = int(np.argmax(counts)) - len(y)
    a, b = x[max(0, best) :], y[max(0, -best) :]
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    loud = (a != SILENT) | (b != SILENT)
    if loud.sum() < OVERLAP:
        return best, int(counts.max()), 1.0
    return best, int(counts.max()), float(np.bitwise_count(a[loud] ^ b[loud]).sum()) / (32 * int(loud.sum()))


def matches(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether x and y align; the same for either order."""
    _, n, errors = align(*sorted((x, y), key=lambda v: v.tobytes()))
    return n >= RUNS and errors <= ERRORS


def fingerprints(media: DataFrame, audio: str = "audio", rec_id: str = "rec_id") -> DataFrame:
    """uid, rec_id, n, digest, prints (binary: little-endian unsigned 32-bit) of each row. To be stashed: uid is new at each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            found = (fingerprint(*samples_of(a.as_py())) for a in batch.column(1))
            prints = [v.astype("<u4").tobytes() if (v != SILENT).any() else b"" for v in found]
            uids = pa.array(range(uid, uid + len(prints)), pa.int64())
            uid += len(prints)
            yield pa.RecordBatch.from_arrays([uids, batch.column(0), pa.array([len(p) // 4 for p in prints], pa.int32()), pa.array([hashlib.md5(p).digest() for p in prints], pa.binary()), pa.array(prints, pa.binary())], names=["uid", "rec_id", "n", "digest", "prints"])

    return media.select(col(rec_id).cast("long").alias("rec_id"), col(audio).alias("audio")).mapInArrow(run, "uid long, rec_id long, n int, digest binary, prints binary")


def grams(prints: bytes) -> set[bytes]:
    """All integers."""
    return {prints[i : i + 4 * KEY] for i in range(0, len(prints) - 4 * KEY + 1, 4)}


def _candidates(prints: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each of q, and those of p that have RUNS equal integers with it at one offset; all that share one where that is long to count."""
    loud = [np.flatnonzero(v != SILENT) for v in prints]
    longest, owner = max(map(len, prints)), np.repeat(np.arange(len(p)), [len(loud[i]) for i in p])
    values, place = np.concatenate([prints[i][loud[i]] for i in p]), np.concatenate([loud[i] for i in p])
    order = np.argsort(values, kind="stable")
    values, owner, place = values[order], owner[order], place[order]
    low = [np.searchsorted(values, prints[j][loud[j]], "left") for j in q]
    many = [np.searchsorted(values, prints[j][loud[j]], "right") - x for j, x in zip(q, low)]
    total = np.array([m.sum() for m in many])
    at = 0
    while at < len(q):
        if total[at] > EXPAND:
            own = np.unique(prints[q[at]][loud[q[at]]], return_index=True)[1]
            yield q[at], p[np.unique(np.concatenate([owner[low[at][k] : low[at][k] + many[at][k]] for k in own]))]
            at += 1
            continue
        end = at + max(1, int(np.searchsorted(np.cumsum(total[at:]), EXPAND, "right")))
        m, n = np.concatenate(many[at:end]), total[at:end].sum()
        hit = np.repeat(np.concatenate(low[at:end]) - np.cumsum(m) + m, m) + np.arange(n)
        mine = np.repeat(np.arange(end - at), total[at:end])
        where = np.repeat(np.concatenate([loud[j] for j in q[at:end]]), m)
        codes, times = np.unique((mine * len(p) + owner[hit]) * (2 * longest) + place[hit] - where + longest, return_counts=True)
        pairs = np.unique(codes[times >= RUNS] // (2 * longest))
        cut = np.searchsorted(pairs, np.arange(end - at + 1) * len(p))
        for k in range(end - at):
            if cut[k] < cut[k + 1]:
                yield q[at + k], p[pairs[cut[k] : cut[k + 1]] % len(p)]
        at = end


def compare(reps: DataFrame) -> DataFrame:
    """a, b, links of reps (rep, n, prints): links that hold the classes together (links null), and each rep's number of links (b null).

    All pairs meet: reps are dealt into blocks, and each pair of blocks is one task, which passes on no more rows than it
    has recordings, twice.
    """
    size = reps.agg(F.count("*").alias("reps"), F.coalesce(F.sum("n"), F.lit(0)).alias("ints")).first()
    blocks = max(1, -(-size["reps"] // BLOCK), -(-size["ints"] // INTEGERS))
    placed = reps.withColumn("i", F.pmod(F.xxhash64(F.lit(7), "rep"), F.lit(blocks)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = placed.select(F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "rep", "prints")

    def run(x: pd.DataFrame) -> pd.DataFrame:
        rep, prints, links = x["rep"].to_numpy(), [np.frombuffer(v, "<u4") for v in x["prints"]], np.zeros(len(x), np.int64)
        p, q = np.flatnonzero(x["i"] == x["p"]), np.flatnonzero(x["i"] == x["q"])
        same, root, held = x["p"].iloc[0] == x["q"].iloc[0], list(range(len(x))), []

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for j, near in _candidates(prints, p, q) if len(p) and len(q) else ():
            for i in near[near < j] if same else near:
                if matches(prints[i], prints[j]):
                    links[[i, j]] += 1
                    a, b = top(i), top(j)
                    if a != b:
                        root[a] = b
                        held.append((rep[i], rep[j]))
        linked = np.flatnonzero(links)
        none = [None] * len(held)
        edges = pd.DataFrame({"a": [a for a, _ in held], "b": [b for _, b in held], "links": none})
        counts = pd.DataFrame({"a": rep[linked], "b": [None] * len(linked), "links": links[linked]})
        return pd.concat([edges.astype("Int64"), counts.astype("Int64")])

    tasks = min(blocks * (blocks + 1) // 2, 4096)
    return tiles.repartition(tasks, "p", "q").groupBy("p", "q").applyInPandas(run, "a long, b long, links long")


def align_recordings(media: DataFrame, audio: str = "audio", rec_id: str = "rec_id") -> DataFrame:
    """rec_id, n_prints, class_id, n_copies, n_links: a row for each row of media.

    class_id is the smallest id among recordings that match it directly or through others; n_copies the rows of equal
    fingerprints; n_links the different fingerprints that match it. Classes and links are exact. Null, unreadable,
    silent and too short recordings have no integers (n_prints 0), match nothing and are no copies; silence within a
    recording gives no match either. An empty table gives no row. Null ids join classes but never
    name them. Repeated rows are copies; extra columns don't matter. Comparing costs the square of the number of
    different fingerprints, spread over tasks in blocks.
    """
    rows = stash(fingerprints(media, audio, rec_id), "chroma-rows")
    reps = stash(rows.where("n > 0").groupBy("digest").agg(F.min("uid").alias("rep"), F.min("prints").alias("prints"), F.min("n").alias("n"), F.count("*").alias("copies")), "chroma-reps")
    found = stash(compare(reps), "chroma-found")
    labels = components(found.where("b is not null").select("a", "b"))
    counted = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    sized = labels.join(counted, F.col("a") == F.col("node"), "left").select("node", "label", "links")
    known = reps.select("digest", "rep", "copies").join(sized, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("label", "rep").alias("label"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    all_rows = stash(rows.select("uid", "rec_id", "n", "digest").join(known, "digest", "left").withColumn("label", F.coalesce("label", "uid")), "chroma-all")
    first = all_rows.groupBy("label").agg(F.min("rec_id").alias("class_id"))
    return all_rows.join(first, "label").select("rec_id", F.col("n").cast("long").alias("n_prints"), "class_id", F.coalesce("copies", F.lit(1)).alias("n_copies"), F.coalesce("links", F.lit(0)).alias("n_links"))


RATE, NOTE = 2000, 160


def tune(vector: list[float] | None) -> bytes:
    """WAV bytes with one note for each component, its pitch from the component's value; empty for null vectors."""
    x = np.array([v if v is not None and np.isfinite(v) else 0.0 for v in vector or []])
    pitch = 110 * 2 ** ((np.floor((x + 1) * 60) % 36) / 12)
    t = np.arange(NOTE) / RATE
    wave_form = (np.sin(2 * np.pi * pitch[:, None] * t) * np.hanning(NOTE) * 20000).astype("<i2").ravel()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes(wave_form.tobytes())
    return out.getvalue()


def tunes(vectors: DataFrame) -> DataFrame:
    """rec_id, audio: the tables hold no sound, so each vector is played as a tune."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([tune(v) for v in part.column(1).to_pylist()], pa.binary())], names=["rec_id", "audio"])

    return vectors.select(F.col("vec_id").cast("long").alias("rec_id"), "embedding").mapInArrow(run, "rec_id long, audio binary")


def op3_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_recordings(tunes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))).withColumnRenamed("rec_id", "vec_id")
