"""Suffix-array dedup against all strings of a length, with periodic texts, hot passages, copies, nulls and empty tables."""

import random
from collections import Counter

import numpy as np
import pytest

from contagraph.llm import suffix_dedup


def plain(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def text_of(r, n, letters):
    return "".join(r.choices(letters, k=n))


def corpus(seed):
    r = random.Random(seed)
    shared = [text_of(r, r.randint(10, 120), "abcdefgh ") for _ in range(25)]
    out = []
    for i in range(160):
        letters = "abcdefghijklmnopqrstuvwxyz é" if i % 3 else "ab"
        out.append("".join(r.choice([lambda: r.choice(shared), lambda: text_of(r, r.randint(0, 60), letters), lambda: r.choice(shared)[r.randint(0, 9) : r.randint(9, 99)]])() for _ in range(r.randint(0, 8))))
    return [*out, *out[:7], None, "", "x" * 39, "x" * 40, "x" * 500, "xy" * 300, "abc" * 100 + "q" + "abc" * 100, "\0" * 90, out[0][:50] + "\0\0", "漢字かな" * 40]


def run(spark, texts, length, **more):
    docs = spark.createDataFrame([(i, t, "k", 7) for i, t in enumerate(texts)], "id long, text string, kept string, n_bytes int").repartition(5)
    got = suffix_dedup.suffix_dedup(docs, length, **more)
    assert got.columns == ["id", "text", "kept", "n_bytes", "n_bytes_", "n_removed", "n_spans", "kept_"]
    rows = sorted(got.collect(), key=lambda r: r["id"])
    assert [r["text"] for r in rows] == texts and {r["kept"] for r in rows} <= {"k"}
    return [(r["n_bytes_"], r["n_removed"], r["n_spans"], bytes(r["kept_"])) for r in rows]


@pytest.mark.parametrize("length, hot", [(40, None), (25, None), (40, 3)])
def test_against_all_strings(spark, length, hot):
    texts = corpus(length)
    assert run(spark, texts, length, hot=hot) == plain(texts, length)


def test_the_usual_length_with_small_ranges(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 40)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    r = random.Random(9)
    shared = [text_of(r, n, "abcdefghijklmnop ") for n in (400, 399, 401, 450, 600, 660, 900, 2500)]
    texts = []
    for _ in range(80):
        texts.append("".join(text_of(r, r.randint(0, 700), "abcdefghijklmnop ") + (s[r.choice([0, 0, 1, 30]) :] if r.random() < 0.5 else s) for s in r.sample(shared, r.randint(0, 3))))
    texts += [text_of(r, 5000, "abc"), "word " * 2000]
    assert run(spark, texts, 400) == plain(texts, 400)
    assert sum(x[1] for x in plain(texts, 400)) > 50_000


def test_empty_table(spark):
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_multikey_order():
    r = np.random.default_rng(1)
    m = r.integers(0, 3, (500, 6), dtype=np.uint64)
    m[100:200] = m[0]
    got = m[suffix_dedup.multikey_order(m)].tolist()
    assert got == sorted(m.tolist())
    assert suffix_dedup.multikey_order(m[:0]).tolist() == [] and suffix_dedup.multikey_order(m[:1]).tolist() == [0]


def test_anchors_of_equal_windows_agree():
    r = random.Random(4)
    part = text_of(r, 900, "ab ").encode()
    for cut in (0, 17, 300):
        a, b = text_of(r, 333, "ab ").encode() + part, text_of(r, 77, "ab ").encode() + part[cut:]
        where = lambda t: {s: x for x, first, last in zip(*suffix_dedup.anchors(t)) for s in range(first, last + 1)}
        x, y = where(a), where(b)
        assert len(x) == len(a) - 399
        for s in range(cut, len(part) - 399):
            assert x[333 + s] - 333 - s == y[77 + s - cut] - 77 - s + cut


def holders(texts, words):
    """Places of the texts that hold `words` words in a row which another one holds too."""
    at = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        for j in range(len(w) - words + 1):
            at.setdefault(tuple(w[j : j + words]), set()).add(i)
    return {i for found in at.values() if len(found) > 1 for i in found}


@pytest.mark.parametrize("together, known", [(1 << 18, 100_000), (70, 30)])
def test_passages_of_words_against_all_runs(spark, monkeypatch, together, known):
    monkeypatch.setattr(suffix_dedup, "WORDS_TOGETHER", together)
    monkeypatch.setattr(suffix_dedup, "WORDS_KNOWN", known)
    r = random.Random(together)
    some = lambda n, k=500: [f"w{r.randrange(k)}" if r.random() < 0.9 else "é漢" for _ in range(n)]
    shared = [some(n) for n in (49, 50, 51, 52, 60, 85, 200)]
    texts = []
    for i in range(120):
        parts = [some(r.randint(0, 80), 2 if i % 7 == 0 else 500), *[s[r.choice([0, 0, 1, 40]) :] for s in r.sample(shared, r.choice([0, 0, 1]))], some(r.randint(0, 80))]
        texts.append("".join(w + r.choice([" ", "\n", "\t ", " \r\n"]) for p in parts for w in p))
    # held twice by one text only; copies that are long enough or not; as many words as fit or one less; the edge of another text
    edge = some(90)
    texts += [" ".join((x := some(51)) + ["-"] + x), *[" ".join(some(70))] * 3, *[" ".join(some(50))] * 2, "a " * 400, "a " * 51, " ".join(edge[:40]), " ".join(edge[40:]), " ".join(edge[:60]), None, "", " \n"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id long, text string, repeats_passage int").repartition(5)
    got = suffix_dedup.suffix_dedup(docs, 400, passage=51)
    assert got.columns == ["id", "text", "repeats_passage", "n_bytes", "n_removed", "n_spans", "kept", "repeats_passage_"]
    rows = sorted(got.collect(), key=lambda x: x["id"])
    assert {x["id"] for x in rows if x["repeats_passage_"]} == holders(texts, 51)
    assert [(x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in rows] == plain(texts, 400)
    # some are too short for 400 bytes, the contract's length, and are told by this column alone
    assert any(x["repeats_passage_"] and not x["n_removed"] for x in rows)


def test_no_passages(spark):
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], "doc_id long, text string"), passage=51).collect() == []
    one = suffix_dedup.suffix_dedup(spark.createDataFrame([(1, "a " * 300), (2, None)], "doc_id long, text string"), passage=51)
    assert {(x["doc_id"], x["repeats_passage"]) for x in one.collect()} == {(1, False), (2, False)}


def test_the_query_tells_shared_passages_shorter_than_its_strings(spark, tmp_path):
    r = random.Random(3)
    passage = " ".join(f"{r.randrange(9999)}" for _ in range(51))
    texts = [f"{i} {passage} {i}" for i in range(2)] + ["only here " + " ".join(f"{r.randrange(9999)}" for _ in range(60))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x for x in suffix_dedup.op13_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [(got[i]["n_removed"], got[i]["repeats_passage"]) for i in range(3)] == [(0, True), (0, True), (0, False)]
