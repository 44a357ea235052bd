"""The corpus pipeline against plain Python, stage by stage, and its stages on odd tables."""

import hashlib
import random

import numpy as np
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
import test_language_id
import test_line_dedup
import test_mixing
from contagraph.llm import language_id
from contagraph.llm.sentencepiece_bpe import default_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in "the of and to in that is was for with on".split() for b in ("", "er", "ing", "ish", "ly")]


def documents():
    """Copies, near copies, shared lines, texts without words, nulls in each column."""
    r = random.Random(21)
    shared = [f"{r.choice(WORDS)} shared line that many documents hold, number {i}" for i in range(6)]
    line = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))
    rows = []
    for i in range(60):
        lines = [line(r.randint(8, 30)) for _ in range(r.randint(1, 4))]
        lines.insert(r.randint(0, len(lines)), r.choice(shared))
        rows.append((i, "\n".join(lines), r.choice(["en", "de"]), r.choice(["web", "books", None, "code"])))
    for i in range(60, 90):  # copies, near copies
        _, text, lang, source = rows[r.randrange(20)]
        rows.append((i, text if i % 2 else text.rsplit(" ", 1)[0] + f" last{i}", lang, source))
    rows += [(90, None, "en", "web"), (91, "", None, "web"), (92, "12 34 !", "en", "books"), (93, "é", "de", None), (None, line(40), "en", "web"), (None, rows[3][1], None, "web"), (94, "word " * 20_000, "en", "code")]
    return [(*x, len(x[1] or "")) for x in rows]


def near(texts):
    """Classes of texts whose sets of five-word runs have a similarity of 0.8 or more, directly or through others."""
    import re

    sets = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    label = list(range(len(texts)))
    top = lambda i: i if label[i] == i else top(label[i])
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                label[top(i)] = top(j)
    return [top(i) for i in range(len(texts))]


def test_against_plain_python(spark, tmp_path):
    rows = documents()
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    labelled = [(d, t, lang) for d, t, lang, _, _ in rows if fold(d) != 0]
    kept = [r for r, (pred, _) in zip(rows, test_language_id.plain(labelled, [(r[0], r[1], r[2]) for r in rows])) if pred != "und"]
    assert {r[0] for r in rows} - {r[0] for r in kept} == {90, 91, 92}
    last, held = {}, {}
    for d, t, *_ in kept:
        d = -(2**63) if d is None else d
        for k in {test_line_dedup.key(x) for x in t.split("\n")}:
            if len(k) >= 20:
                held.setdefault(k, set()).add(d)
                last[k] = max(last.get(k, d), d)
    cut = []
    for d, t, lang, source, _ in kept:
        me = -(2**63) if d is None else d
        text = "\n".join(x for x in t.split("\n") if not (k := test_line_dedup.key(x)) in held or len(held[k]) < 3 or last[k] == me)
        cut.append((d, text, lang, source, len(text)))
    classes = near([r[1] for r in cut])
    by_class = {}
    for r, c in zip(cut, classes):
        by_class.setdefault(c, []).append(r)
    single = [min(group, key=lambda r: (r[0] is None, r[0] or 0)) for group in by_class.values()]
    assert len(single) < len(cut)
    decided = {(d, s, n): k for d, s, n, copy, _, _, k, _ in test_mixing.plain([(r[0], r[3], r[1]) for r in single]) if copy == 1}
    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    want = []
    for d, text, lang, source, n in single:
        ids = sp.encode(text, add_bos=True, add_eos=True)
        row = (d, lang, source, n, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
        want += [row] * decided[d, source, test_mixing.words(text)]
    got = [(r["doc_id"], r["lang"], r["source"], r["n_chars"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 40


def fold(doc_id):
    import zlib

    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs = spark.createDataFrame(documents(), SCHEMA).withColumn("score", F.lit("own")).withColumn("copies", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert "text" not in last.columns and last.count() == docs.count()


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert language_id.fold(F.lit(1)) is not None
