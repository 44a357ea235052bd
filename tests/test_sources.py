"""FASTA as a data source, quantile sketches, and links as a stream."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contagraph.functions.columns import bases, pack, unpack
from contagraph.operators.sketches import BOUND, approximate_percentiles, merged, sketches
from contagraph.sources import fasta
from contagraph.streaming.links import best_links


def test_fasta_source(spark, tmp_path):
    """What was written comes back, in splits of any size; half-written files aren't seen, and an overwrite replaces."""
    fasta.register_fasta(spark)
    r = random.Random(3)
    texts = ["".join(r.choices("ACGT", k=r.choice([0, 1, 31, 32, 33, 99, 100, 101, 700]))) for _ in range(120)]
    codes = [["ACGT".index(c) for c in t] for t in texts]
    rows = spark.createDataFrame([(f"case {i}", c, len(c)) for i, c in enumerate(codes)], "node string, codes array<int>, length int").select("node", pack(F.col("codes")).alias("words"), "length").repartition(4)
    path = str(tmp_path / "out")
    rows.write.format("fasta").mode("append").save(path)
    (tmp_path / "out" / "_part-00009-left.fa").write_text(">never committed\nACGT\n")
    want = sorted((f"case {i}", t) for i, t in enumerate(texts))
    for split in (37, 1000, 10**9):
        read = spark.read.format("fasta").option("split", split).load(path)
        got = sorted(map(tuple, read.select("node", bases(unpack(F.col("words"), F.col("length")))).collect()))
        assert got == want
    assert read.join(rows, ["node", "words", "length"]).count() == len(texts)
    rows.limit(3).write.format("fasta").option("width", 7).mode("overwrite").save(path)
    assert spark.read.format("fasta").load(path).count() == 3
    one = tmp_path / "one.fa"
    one.write_bytes(b">a first\r\nACGT\r\nAC\r\n>b\r\n>c\r\nTT")
    got = spark.read.format("fasta").option("split", 5).load(f"file://{one}")
    assert sorted((x["node"], x["length"]) for x in got.collect()) == [("a first", 6), ("b", 0), ("c", 2)]
    one.write_text(">a\nACGN\n")
    with pytest.raises(Exception, match="letter other than ACGT"):
        spark.read.format("fasta").load(str(one)).collect()


def test_packing_in_tasks_is_that_of_columns(spark):
    r = random.Random(5)
    for n in (0, 1, 32, 64, 65, 200):
        text = "".join(r.choices("ACGT", k=n))
        words = spark.range(1).select(pack(F.array(*[F.lit("ACGT".index(c)) for c in text]) if n else F.array().cast("array<int>")).alias("w")).first()["w"]
        assert fasta.pack_bases(text.encode()).tolist() == words and fasta.unpack_words(np.array(words, np.int64), n) == text


def test_sketches(spark):
    """Near the exact share, also merged from parts, for values that repeat and for two labels; NaN, null and unknown labels."""
    rng = np.random.default_rng(1)
    x = {"a": rng.normal(0, 5, 60_000), "b": np.round(rng.exponential(4, 30_000), 1)}
    draws = spark.createDataFrame(pd.DataFrame([(k, v) for k, a in x.items() for v in a], columns=["label", "v"])).repartition(6)
    more = spark.createDataFrame([("a", None), ("b", float("nan")), ("empty", None)], "label string, v double")
    asked = [-30.0, -5.0, 0.0, 0.1, 2.5, 4.0, 7.7, 40.0, float("nan"), None]
    obs = spark.createDataFrame([(k, v) for k in ("a", "b", "empty") for v in asked], "label string, x double")
    whole = sketches(draws.unionByName(more), "v")
    parts = merged(*[sketches(draws.where(F.pmod(F.xxhash64("v"), F.lit(3)) == i), "v") for i in range(3)])
    for kept in (whole, parts):
        assert {r["label"]: r["n"] for r in kept.select("label", "n").collect()} == {"a": 60_000, "b": 30_000}
        assert kept.agg(F.max(F.length("sketch"))).first()[0] < 200_000
        got = approximate_percentiles(obs, kept, "x").collect()
        assert len(got) == 2 * len(asked)
        for r in got:
            exact = 0.0 if r["x"] is None or r["x"] != r["x"] else float((x[r["label"]] <= r["x"]).mean())
            assert abs(r["percentile"] - exact) <= BOUND


def test_links_stream_with_late_rows(spark, tmp_path):
    """Files in turn: ties go to the smaller link, null scores lose, rows past the watermark's window are dropped, others aren't."""
    at = lambda hours: datetime(2024, 1, 1) + timedelta(hours=hours)
    schema = "case_id long, linked long, score double, at timestamp"
    files = [
        [(1, 10, 0.5, at(1)), (1, 9, 0.5, at(2)), (2, 7, None, at(3)), (None, 1, 9.0, at(3)), (3, 1, 9.0, None)],
        [(1, 11, 0.7, at(5)), (2, 8, 0.1, at(30)), (1, 12, 0.2, at(31)), (4, 1, 0.3, at(60))],
        [(1, 99, 0.9, at(6)), (1, 13, 0.4, at(59)), (4, 2, 0.9, at(49)), (5, 1, 0.1, at(200))],
    ]
    given = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    out = {}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(given)
    q = None
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(given)
        q = q or best_links(stream, "1 day", "1 hour").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, n: out.update({(r["start"], r["case_id"]): (r["linked"], r["score"], r["seen"]) for r in df.collect()})).start()
        q.processAllAvailable()
    q.stop()
    day = lambda n: datetime(2024, 1, n)
    # the second file moves the watermark to hour 59, past the first two days: the link of hour 6 comes too late
    want = {(day(1), 1): (11, 0.7, 3), (day(1), 2): (7, None, 1), (day(2), 2): (8, 0.1, 1), (day(2), 1): (12, 0.2, 1), (day(3), 4): (2, 0.9, 2), (day(3), 1): (13, 0.4, 1), (day(9), 5): (1, 0.1, 1)}
    assert out == want
    late = (1, 99, 0.9, at(6))
    batch = best_links(spark.createDataFrame([r for f in files for r in f if r != late], schema), "1 day")
    assert {(r["start"], r["case_id"]): (r["linked"], r["score"], r["seen"]) for r in batch.collect()} == want


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    from contagraph.plans import shared

    monkeypatch.setattr(shared, "_MADE", set())
    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    kept = [shared.materialised(spark.range(3), name) for name in ("a", "b", "c")]
    assert sorted(p.name[0] for p in tmp_path.iterdir()) == ["a", "b", "c"] and kept[1].count() == 3
    shared.discard(kept[0], None, spark.range(1))
    assert sorted(p.name[0] for p in tmp_path.iterdir()) == ["b", "c"]
    shared.discard_all(spark)
    assert not [p for p in tmp_path.iterdir() if not p.name.endswith(".crc")] and not shared._MADE


def test_codes_are_checked_while_they_are_packed(spark):
    from contagraph.operators.sequences import packed

    raw = spark.createDataFrame([(i, [0, 1, 2, 3, i % 4]) for i in range(50)], "idx int, codes array<int>").repartition(3)
    sc = spark.sparkContext
    sc.setJobGroup("packed", "packed")
    out = packed(raw)
    jobs = len(sc.statusTracker().getJobIdsForGroup("packed"))
    sc.setJobGroup("read", "read")
    raw.write.format("noop").mode("overwrite").save()
    assert jobs <= len(sc.statusTracker().getJobIdsForGroup("read")) and out.count() == 50
    for bad, match in (([0, 4, 1, 1, 1], "0..3"), ([-1] * 5, "0..3"), ([1], "one length")):
        with pytest.raises(ValueError, match=match):
            packed(raw.unionByName(spark.createDataFrame([(99, bad)], "idx int, codes array<int>")))
    assert packed(raw.limit(0)).count() == 0
