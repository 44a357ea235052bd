"""Edge cases and brute-force checks on small tables: nulls, empty and long texts, ties, repeated rows, clashing names."""

import gzip
import hashlib
import math
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from contagraph.llm import chroma, class_lm, collision_ann, jaccard_join, language_id, line_dedup, mixing, secrets, warc
from contagraph.llm.components import components
from contagraph.llm.sentencepiece_bpe import PieceModel, default_model, encode_decode

WORDS = "the of and to in that is was for with on by this be as from have not are they which one you were all her she there would their".split()


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 50)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = text(1, 80)
    near = base.rsplit(" ", 2)[0] + " other words"
    line = "This line is long enough to count"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "b"), (4, text(2, 60), "fr", None), (5, None, "fr", "b"), (6, "", None, "c"),
        (7, f"{line}\nx\n  {line.upper()}", "en", "c"), (8, f"{line}\ny", "en", "a"), (9, line, "en", "a"), (9, line, "en", "a"), (10, "word " * 30000, "en", "b"), (None, "no id", "en", "a"),
    ]
    return spark.createDataFrame([(*r, 0, "kept") for r in rows], "doc_id long, text string, lang string, source string, n_lines int, score string")


def test_line_dedup(docs):
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert [got[i]["text"] for i in (5, 6, 7, 8, 9)] == ["", "", "x", "y", "This line is long enough to count"]
    assert (got[7]["n_lines_"], got[7]["n_dropped"], got[7]["n_lines"]) == (3, 2, 0)
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_mixing(docs, spark):
    decided = mixing.mixing_decisions(docs).collect()
    assert len(decided) == docs.count() and all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in decided)
    assert sorted(map(tuple, mixing.mixing_decisions(docs.repartition(3)).collect()), key=repr) == sorted(map(tuple, decided), key=repr)
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs).count() == sum(r["copies"] for r in decided)
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"))
    for r in mixing.mixing_decisions(many).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 40
    assert mixing.mixing_decisions(docs.limit(0)).count() == 0


def test_sentencepiece(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    model = PieceModel(open(default_model(), "rb").read())
    r = random.Random(3)
    odd = ["", " ", "\n\n a", "a▁▁b", "日本 😀 é\x00", "x" * 3000] + ["".join(r.choice("the of▁  \nabcé日😀01_") for _ in range(r.randint(0, 60))) for _ in range(300)]
    for t in odd:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        raw = np.array(ids, "<u4").tobytes()
        assert model.encode(t) == raw and model.decode(raw) == sp.decode(ids)
    got = {r["doc_id"]: r for r in encode_decode(docs).collect()}
    assert got[5]["n_tokens"] == 2 and got[5]["decoded"] == "" and got[10]["decoded"] == "word " * 30000
    assert encode_decode(docs.limit(0)).count() == 0 and encode_decode(docs.withColumnRenamed("score", "IDS")).columns[-3:] == ["n_tokens", "ids_", "decoded"]


def test_class_lm(docs):
    model, counts = class_lm.train(docs.where("doc_id < 5"), clustered=10, groups=8, classes=4)
    got = class_lm.score(docs, model, counts).collect()
    assert len(got) == docs.count() and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    empty, counts = class_lm.train(docs.limit(0))
    assert empty.n == 0 and all(r["base_score"] == pytest.approx(0) for r in class_lm.score(docs.limit(2), empty, counts).collect())


def test_class_lm_clusters_3000_words_and_long_ones(spark):
    long = "pneumonoultramicroscopicsilicovolcanoconiosis"
    words = [f"w{i}" for i in range(3100)] * 2 + [long] * 5
    random.Random(6).shuffle(words)
    rows = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    model, counts = class_lm.train(rows, classes=3)
    assert len(model.words) == 3101 and model.words[0] == class_lm._key(long.encode())
    own = {u for u in class_lm.count_bigrams(rows, model.words[: class_lm.CLUSTERED]).toPandas()["a"] if u < class_lm.CLUSTERED}
    assert len(own) == class_lm.CLUSTERED >= 3000 and 0 in own
    got = class_lm.score(spark.createDataFrame([(2, long)], "doc_id long, text string"), model, counts).collect()[0]
    assert got["n_known"] == 2 and got["base_score"] == pytest.approx(math.log10(5.5 * 1.5) - 2 * math.log10(model.n + 0.5 * (model.v + 1)))


def test_class_lm_adds_up_to_one(spark):
    words = text(5, 300)
    one = spark.createDataFrame([(1, words)], "doc_id long, text string")
    model, counts = class_lm.train(one, clustered=12, groups=4, classes=5)
    step = 10.0 ** model.step
    assert np.allclose(step.sum(1), 1)
    unit = np.concatenate([model.emit[: len(model.words)], [model.emit[-1]]])
    unseen = 10.0 ** (model.emit[len(model.words) : -1] + math.log10(0.5))
    p = np.bincount(np.concatenate([model.cls[: len(model.words)], [model.cls[-1]], model.cls[len(model.words) : -1]]), np.concatenate([10.0**unit, unseen]))
    assert np.allclose(p, 1)


def test_language_id(docs, spark):
    rows = [(i, " ".join(random.Random(i).choices(w, k=20)), lang) for lang, w in (("x", ["alpha", "beta", "gamma"]), ("y", ["uno", "dos", "tres"])) for i in range(20)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "unos"), (3, None), (4, "12 ½ !"), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(asked, model).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["x", "y", "und", "und", "und"] and all(0 <= s <= 1 for _, s in got.values())
    assert language_id.train(docs.limit(0)).predict("alpha") == ("und", 0.0)
    assert language_id.identify(docs, model).columns[-2:] == ["lang_pred", "score_"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 100), (5, 5)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[100] == got[101] == 100


def test_jaccard_join(docs, spark):
    rows = [r for r in jaccard_join.similar(docs).collect()]
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == docs.count() and got[1]["class_id"] == got[2]["class_id"] == got[3]["class_id"] == 1
    assert got[1]["n_copies"] == 2 and got[1]["n_links"] == 1 and got[4]["n_links"] == 0 and got[5]["stays"] and got[6]["stays"]
    assert sorted((r["doc_id"] or 0) for r in jaccard_join.keep_one(docs).collect()) == [0, 1, 4, 5, 6, 7, 8, 9, 10]
    assert jaccard_join.similar(docs.limit(0)).count() == 0
    # a large group of near copies: links against brute force
    r = random.Random(1)
    body = text(7, 120).split()
    near = []
    for i in range(150):
        w = list(body)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"q{r.randint(0, 9)}"
        near.append((i, " ".join(w)))
    h = jaccard_join._Hashes()
    sets = {i: jaccard_join.shingles(t, h) for i, t in near}
    texts = {}
    for i, s in sets.items():
        texts.setdefault(s.tobytes(), i)
    reps = list(texts.values())
    link = {i: 0 for i in reps}
    for i in reps:
        for j in reps:
            both = len(np.intersect1d(sets[i], sets[j]))
            link[i] += i != j and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)
    found = jaccard_join.similar(spark.createDataFrame(near, "doc_id long, text string")).collect()
    assert all(x["n_links"] == link[texts[sets[x["doc_id"]].tobytes()]] for x in found)


def test_warc(spark, tmp_path):
    big = "é" * 30000
    pages = [(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "v", ""), (5, "w", big), (6, "a\r\nb", "WARC/1.1\r\n\r\nx"), (7, "z", "solo"), (7, "z", "solo")]
    path = "file://" + str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    read = warc.read_warc(spark, path)
    rows = warc.revisits_resolved(read).collect()
    assert len(rows) == len(pages) and all(r["intact"] for r in rows)
    got = {r["page_id"]: r for r in rows}
    assert (got[1]["record_type"], got[1]["refers_to"], got[1]["payload_bytes"]) == ("revisit", 2, 4) and got[3]["refers_to"] == 4
    assert got[5]["payload_bytes"] == 60000 and got[5]["payload_digest"] == warc.digest(big.encode())
    assert {bytes(r["payload"]).decode() for r in read.where("payload is not null").collect()} == {"same", "", big, "WARC/1.1\r\n\r\nx", "solo"}
    assert warc.dechunked(warc.chunked(b"abc" * 5000)) == b"abc" * 5000
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nab")


def test_warc_with_a_gzip_member_a_record(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + b"long " * 100
    out = []
    for i, segment in ((1, 1000), (2, 200)):
        said = "sha1:" + warc.digest(b"long " * 100)
        out += warc.response({"WARC-Record-ID": f"<urn:page:{i}:x>", "X-Page-ID": str(i), "WARC-Payload-Digest": said}, block, segment)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in out))
    got = sorted((r["page_id"], r["payload_bytes"], r["intact"]) for r in warc.read_warc(spark, f"file://{tmp_path}").collect())
    assert len(out) == 4 and got == [(1, 500, True), (2, 500, True)]


def test_ann(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 8)).astype("float32")
    x[10:40] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] + [1.0] * 7), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collision_ann.nearest(df, df.where("vec_id % 20 = 0"), k=5, block=150).toPandas()
    hits = 0
    for q in range(0, 400, 20):
        s = (x.astype(float) * x[q].astype(float)).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(400), -s))[:5]
        hits += len(set(best) & set(got[got.query_id == q].vec_id))
    assert hits >= 0.95 * 100 and len(got) == 100
    assert collision_ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_secrets(spark):
    forest = secrets.fit(secrets.example_findings(1500))
    fresh = secrets.example_findings(600, seed=99)
    x = np.array([secrets.features(*r) for r in fresh[["value", "left", "right", "path"]].itertuples(index=False)])
    assert ((forest.predict(x) >= 0.5) == fresh["label"]).mean() > 0.93
    key = hashlib.sha1(b"k").hexdigest()
    rows = [(1, f'x token = "{key}" y', "a"), (2, None, None), (3, "", "a"), (4, "call 4734663219866878 now", None), (5, f"commit {key}", "a")]
    got = {(r["doc_id"], r["start"], r["length"]): r["is_secret"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), forest).collect()}
    assert got[1, 11, 40] and not got[4, 5, 16] and not got[5, 7, 40] and len(got) == 3


def test_secrets_long_and_without_digits():
    r = random.Random(4)
    long, key = "!".join("".join(r.choices("abcdefgh", k=9)) for _ in range(40)), "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=40))
    assert secrets.candidates(f"token={long} end") == [(6, 6 + len(long))] and len(long) > 128
    assert secrets.candidates(f"see {key} there") == [(4, 44)]
    assert secrets.candidates("password: qwertyuiopasdfghjkl!x end") == [(10, 31)]
    forest = secrets.fit(secrets.example_findings(1500))
    plain = ["documentation_management", "-" * 40, "internationalization", "state-of-the-art-things", "src/main/resources/templates"]
    x = np.array([secrets.features(v, "see ", " there", "a") for v in [key, *plain]])
    assert list(forest.predict(x) >= secrets.KEEP) == [True] + [False] * len(plain)


def test_chroma(spark):
    rng = np.random.default_rng(4)
    tune = rng.uniform(-0.5, 0.5, 80)
    noisy, late, other = tune + 0.0, np.concatenate([rng.uniform(-0.5, 0.5, 8), tune[:72]]), rng.uniform(-0.5, 0.5, 80)
    rows = [(1, chroma.tune(list(tune))), (2, chroma.tune(list(noisy))), (3, chroma.tune(list(late))), (4, chroma.tune(list(other))), (5, None), (6, b"no wave"), (7, chroma.tune([]))]
    a, b = (chroma.fingerprint(*chroma.samples_of(r[1])) for r in (rows[0], rows[2]))
    assert chroma.align(a, b)[0] == -8 * chroma.NOTE // chroma.HOP and chroma.matches(a, b)
    got = {r["rec_id"]: r for r in chroma.align_recordings(spark.createDataFrame(rows, "rec_id long, audio binary")).collect()}
    assert [got[i]["class_id"] for i in range(1, 8)] == [1, 1, 1, 4, 5, 6, 7] and got[1]["n_copies"] == 2 and got[3]["n_links"] == 1


def test_chroma_against_brute_force(spark, monkeypatch):
    """Four tunes share an opening, so their keys hold several classes; each has versions with some notes changed."""
    monkeypatch.setattr(chroma, "BLOCK", 3)
    rng, rows = np.random.default_rng(9), []
    opening = rng.random(10)
    for _ in range(4):
        tune = np.concatenate([opening, rng.random(30)])
        for changed in (0, 1, 2, 3, 6, 12):
            own = tune.copy()
            own[rng.choice(np.arange(10, 40), changed, replace=False)] = rng.random(changed)
            rows.append((int(rng.integers(1, 10**6)), chroma.tune(list(own))))
    prints = {i: chroma.fingerprint(*chroma.samples_of(a)) for i, a in rows}
    runs = {i: chroma.grams(v.astype("<u4").tobytes()) for i, v in prints.items()}
    links = {i: {j for j in prints if i != j and runs[i] & runs[j] and chroma.matches(prints[i], prints[j])} for i in prints}
    label = {i: i for i in prints}
    for _ in prints:
        label = {i: min(label[i], *(label[j] for j in links[i])) if links[i] else label[i] for i in prints}
    got = {r["rec_id"]: (r["class_id"], r["n_links"]) for r in chroma.align_recordings(spark.createDataFrame(rows, "rec_id long, audio binary")).collect()}
    assert got == {i: (label[i], len(links[i])) for i in prints}
    assert 1 < len(set(label.values())) < len(rows) and max(map(len, links.values())) > 2


@pytest.mark.parametrize("expand", [10**6, 50])
def test_chroma_without_runs_against_brute_force(spark, monkeypatch, expand):
    """Every other integer has a flipped bit, so no two recordings share two in a row."""
    rng, prints = np.random.default_rng(12), {}
    for c in range(3):
        base = rng.integers(0, 2**32, 60, np.uint32)
        for v in range(4):
            own = base[rng.integers(0, 5) :].copy()
            own[v % 2 :: 2] ^= np.uint32(1) << rng.integers(0, 32, len(own[v % 2 :: 2]), np.uint32)
            prints[10 * c + v] = own
    prints[90], prints[91] = np.full(60, 7, np.uint32), np.full(40, 7, np.uint32)
    monkeypatch.setattr(chroma, "BLOCK", 5)
    size = {i: len(v) for i, v in prints.items()}
    reps = spark.createDataFrame([(i, size[i], v.astype("<u4").tobytes()) for i, v in prints.items()], "rep long, n int, prints binary")
    links = {i: {j for j in prints if i != j and chroma.matches(prints[i], prints[j])} for i in prints}
    index, every = np.arange(len(prints)), list(prints.values())
    monkeypatch.setattr(chroma, "EXPAND", expand)
    near = {(int(min(i, j)), int(max(i, j))) for j, found in chroma._candidates(every, index, index) for i in found if i != j}
    ids = list(prints)
    assert {(ids.index(i), ids.index(j)) for i in ids for j in links[i] if i < j} <= near
    found = chroma.compare(reps)
    got = {r["a"]: r["n"] for r in found.where("b is null").groupBy("a").agg(F.sum("links").alias("n")).collect()}
    assert got == {i: len(v) for i, v in links.items() if v} and len(got) > 6
    label = {r["node"]: r["label"] for r in components(found.where("b is not null").select("a", "b")).collect()}
    assert all(label[i] == label[j] for i in links for j in links[i])


def test_chroma_at_two_rates():
    rng = np.random.default_rng(8)
    pitch, loud = 110 * 2 ** (rng.integers(0, 36, 90) / 12), rng.uniform(0.2, 1, 90)

    def play(rate):
        t = np.arange(int(rate * 9)) / rate
        note = np.minimum((t / 0.1).astype(int), 89)
        return loud[note] * np.sin(2 * np.pi * pitch[note] * t) * np.sin(np.pi * t / 0.1) ** 2

    slow, fast, other = (chroma.fingerprint(play(r), r) for r in (8000, 44100, 2000))
    assert abs(len(slow) - len(fast)) <= 1 and chroma.matches(slow, fast) and chroma.matches(other, fast)
    assert chroma.align(slow, fast)[0] == 0


@pytest.mark.parametrize("doc_id", [None, 5])
def test_keep_one_keeps_the_rows_that_stay(spark, doc_id):
    """Near copies, an exact copy and texts of their own, all of one id."""
    rows = []
    for k in range(6):
        base = text(100 + k, 80)
        rows += [(doc_id, base, k), (doc_id, base.rsplit(" ", 2)[0] + " other words", k), (doc_id, base, k), (doc_id, text(200 + k, 60), 10 + k)]
    rows += [(doc_id, None, 20), (doc_id, None, 20), (doc_id, "!", 21), (doc_id, "!", 21)]
    got = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, `a.b` int"))
    assert got.columns == ["doc_id", "text", "a.b"]
    assert sorted(r["a.b"] for r in got.collect()) == [*range(6), *range(10, 16), 20, 20, 21, 21]


def test_language_stage_keeps_unsure_rows(spark):
    import corpus_pipeline

    rows = [(i, " ".join(random.Random(i).choices(w, k=20)), lang) for lang, w in (("x", ["alpha", "beta", "gamma"]), ("y", ["uno", "dos", "tres"])) for i in range(20)]
    rows += [(100 + i, w, "x") for i, w in enumerate(["a", "o", "t", "e", "m", "zz", "12 !"])]
    rows += [(122, "жж", "x")]  # held out, and in no learnt letter
    asked = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.identify(asked, language_id.train(language_id.training_rows(asked))).collect()
    known = [r["doc_id"] for r in found if r["lang_pred"] != "und"]
    assert any(r["score"] < 0.6 for r in found if r["lang_pred"] != "und") and 106 not in known
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_stage(spark, asked, "").collect()) == sorted(known)


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert "ids_sha256" in out.columns and {r["doc_id"] for r in out.select("doc_id").collect()} <= {1, 2, 3, 4, 7, 8, 9, 10, None}
