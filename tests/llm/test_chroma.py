"""Silence, repeats and empty tables of recordings."""

import io
import wave

import numpy as np

from contagraph.llm import chroma


def wav(samples, rate=2000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.asarray(samples) * 20000).astype("<i2").tobytes())
    return out.getvalue()


def notes(seed, n):
    t = np.arange(160) / 2000
    pitch = 110 * 2 ** (np.random.default_rng(seed).integers(0, 36, n) / 12)
    return np.concatenate([np.sin(2 * np.pi * p * t) * np.hanning(160) for p in pitch])


def test_silence(spark):
    """Silent recordings match nothing, and a long silence in both doesn't make two tunes match or one tune differ from itself."""
    still, x, y = np.zeros(20_000), notes(1, 60), notes(2, 60)
    rows = [(1, wav(still[:8000])), (2, wav(still)), (3, wav(still)), (4, wav([*x, *still])), (5, wav([*y, *still])), (6, wav([*still[:3200], *x, *still])), (7, wav([*still, *y]))]
    a, b = (chroma.fingerprint(*chroma.samples_of(r[1])) for r in (rows[3], rows[4]))
    assert (a[-50:] == chroma.SILENT).all() and (b[-50:] == chroma.SILENT).all() and not chroma.matches(a, b)
    got = {r["rec_id"]: (r["n_prints"], r["class_id"], r["n_copies"], r["n_links"]) for r in chroma.align_recordings(spark.createDataFrame(rows, "rec_id long, audio binary")).collect()}
    assert [got[i] for i in (1, 2, 3)] == [(0, 1, 1, 0), (0, 2, 1, 0), (0, 3, 1, 0)]
    assert [got[i][1:] for i in (4, 5, 6, 7)] == [(4, 1, 1), (5, 1, 1), (4, 1, 1), (5, 1, 1)]


def test_repeated_and_null_ids(spark):
    x, y = wav(notes(3, 50)), wav(notes(4, 50))
    rows = [(1, x, "k"), (1, x, "k"), (2, y, "k"), (None, x, "k"), (None, y, "k"), (None, None, "k"), (3, b"RIFF", "k")]
    got = chroma.align_recordings(spark.createDataFrame(rows, "rec_id long, audio binary, uid string"))
    assert sorted(map(tuple, got.select("rec_id", "class_id", "n_copies", "n_links").collect()), key=repr) == sorted([(1, 1, 3, 0), (1, 1, 3, 0), (None, 1, 3, 0), (2, 2, 2, 0), (None, 2, 2, 0), (None, None, 1, 0), (3, 3, 1, 0)], key=repr)
    assert chroma.align_recordings(spark.createDataFrame([], "rec_id long, audio binary")).count() == 0
