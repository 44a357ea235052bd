"""Language ID against plain Python, on odd labels and long texts."""

import math
import random
import re
from collections import Counter

import pytest

from contagraph.llm import language_id

ALPHABETS = {"en": "aeiounst", "EN": "aeourkl", "item": "àéiouvz", "all": "жеоиан", "kind": "aeiqxyw"}


def texts(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(ALPHABETS))
        out.append((i, " ".join("".join(r.choices(ALPHABETS[lang], k=r.randint(1, 6))) + r.choice(["", ".", "9", "_x", " 12 "]) for _ in range(r.randint(1, 30))), lang))
    return out


def words(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def grams(word, n):
    p = f"^{word}$"
    return [p[i : i + n] for i in range(len(p) - n + 1)]


def plain(labelled, asked):
    langs = sorted({lang for _, t, lang in labelled if lang is not None and t is not None})
    known, parts = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for _, t, lang in labelled:
        if t is not None and lang is not None:
            for w in words(t):
                known[lang][w] += 1
                for n in (1, 2, 3, 4):
                    parts[lang].update(grams(w, n))

    def table(counts):
        every = {k for c in counts.values() for k in c}
        return {k: [math.log((counts[x][k] + 0.5) / (sum(counts[x].values()) + 0.5 * (len(every) + 1))) for x in langs] for k in every}

    known, parts = table(known), table(parts)
    out = []
    for _, t, _ in asked:
        found = words(t)
        if not any(c.isalpha() for w in found for c in w):
            out.append(("und", 0.0))
            continue
        total = [0.0] * len(langs)
        for w in found:
            row = known.get(w)
            for n in (4, 3, 2, 1):
                if row is None and (hit := [parts[g] for g in grams(w, n) if g in parts]):
                    row = [sum(x) / len(hit) for x in zip(*hit)]
            total = [a + b for a, b in zip(total, row or [0.0] * len(langs))]
        best = max(range(len(langs)), key=lambda k: total[k])
        out.append((langs[best], 1 / sum(math.exp(x - total[best]) for x in total)))
    return out


@pytest.mark.parametrize("labels", [language_id.BROADCAST_LABELS, 0])
def test_against_plain_python(spark, monkeypatch, labels):
    """Labels that differ in case alone or are names of columns; the same whether their table is broadcast or salted, or few words are kept."""
    monkeypatch.setattr(language_id, "BROADCAST_LABELS", labels)
    monkeypatch.setattr(language_id, "TOGETHER", 40)
    monkeypatch.setattr(language_id, "CACHE", 30)
    labelled = texts(1, 120) + [(500, None, "en"), (501, "aaa", None), (502, "", "EN")]
    asked = texts(2, 60) + [(900, None, ""), (901, "12 ½ _ !", ""), (902, "", ""), (903, "aei " * 500 + "жжж", ""), (904, "ßß ΩΩ 日本", ""), (905, "x" * 5000, "")]
    model = language_id.train(spark.createDataFrame(labelled, "doc_id long, text string, lang string"))
    got = [model.predict(t) for _, t, _ in asked]
    want = plain(labelled, asked)
    assert [p for p, _ in got] == [p for p, _ in want]
    assert all(a == pytest.approx(b, abs=1e-4) for (_, a), (_, b) in zip(got, want))
    frame = spark.createDataFrame(asked, "doc_id long, text string, Lang_Pred string")
    rows = language_id.identify(frame, model)
    assert rows.columns == ["doc_id", "text", "Lang_Pred", "lang_pred_", "score"]
    assert {r["doc_id"]: (r["lang_pred_"], r["score"]) for r in rows.collect()} == {i: g for (i, _, _), g in zip(asked, got)}


def test_sample_of_each_language(spark):
    """A language of many documents is sampled, one of few is not."""
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    rows = [(i, f"big x{name(i)}", "a") for i in range(3000)] + [(i, f"small y{name(i)}", "b") for i in range(20)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=100)
    n = len(model.words.keys)
    assert model.languages == ["a", "b"] and 20 + 60 < n - 2 < 20 + 150


def test_held_out_accuracy(spark):
    rows = texts(5, 1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(language_id.training_rows(docs))
    held = language_id.identify(docs.where(language_id.fold(docs.doc_id) == 0), model).collect()
    long = [r for r in held if len(words(r["text"])) >= 8]
    assert len(long) > 100 and sum(r["lang"] == r["lang_pred"] for r in long) > 0.97 * len(long)
