"""Line dedup against plain Python, and on long texts."""

import random

from contagraph.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(BLANKS))


def plain(rows, least=20, docs=3):
    last, held = {}, {}
    for did, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least:
                d = -(2**63) if did is None else did
                held.setdefault(k, set()).add(d)
                last[k] = max(last.get(k, d), d)
    out = []
    for did, text in rows:
        lines = (text or "").split("\n")
        d = -(2**63) if did is None else did
        kept = [x for x in lines if len(k := key(x)) < least or len(held[k]) < docs or last[k] == d]
        out.append((did, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_against_plain_python(spark):
    r = random.Random(3)
    pool = [f"{'éa b'[i % 3]}{' ' * (i % 4)}A shared line of number {i:03d}" for i in range(60)] + ["short", "", " \t ", "ÀÉ upper stays as it is here", "x" * 20, "x" * 19]
    rows = [(i if r.random() < 0.9 else None, "\n".join(r.choice([str.upper, str.lower, lambda s: f"\t{s} \r"])(r.choice(pool)) for _ in range(r.randint(0, 30)))) for i in range(200)]
    rows += [(5, rows[5][1]), (7, None), (8, ""), (9, "\n\n"), (10, "word " * 50_000), (11, "word " * 50_000), (12, "WORD " * 50_000)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_thousands_of_lines(spark):
    """All lines of three long texts are shared; the largest id keeps them."""
    rows = [(i, "\n".join(f"this line has the number {j} and repeats" for j in range(20_000) for _ in range(2 if j % 5 == 0 else 1))) for i in (1, 2, 3)]
    rows[1] = (2, rows[1][1] + "\nbut this one is found in no other text")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (24_000, 24_000, "") and got[2] == (24_001, 24_000, "but this one is found in no other text") and got[3] == (24_000, 0, rows[2][1])


def test_names_that_clash(spark):
    rows = [(i, "this long line is in all texts here", 1, 2, "z") for i in range(4)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, did int, Gone int, `a.b` string"))
    assert got.columns == ["doc_id", "text", "did", "Gone", "a.b", "n_lines", "n_dropped"]
    assert sorted(r["n_dropped"] for r in got.collect()) == [0, 1, 1, 1]


def test_a_line_of_every_text_is_split(spark):
    """The join of lines with the frequent ones splits the one that all texts hold."""
    from test_warc import skewed

    plans = []

    def run(spark):
        found = line_dedup.line_dedup(docs).drop("text")
        rows = found.collect()
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return sum(r["n_dropped"] for r in rows), len(rows)

    docs = spark.range(30_000).selectExpr("id as doc_id", "concat('one line that every text holds\n', 'own ', id) as text").repartition(8)
    assert skewed(spark, run) == (29_999, 30_000) and "skew=true" in plans[0]
