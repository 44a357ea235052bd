
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contagraph import cli
from contagraph.exceptions import ConfigurationError, SimulationError
from contagraph.functions.columns import pack, unpack
from contagraph.operators.pairs import pair_case_table, pair_sums
from contagraph.operators.sequences import along_tree, changed_words, distance_matrix, hamming_pairs, packed, simulate_sequences
from contagraph.operators.trees import check_forest, exact_sample, path_sums, related, siblings, simulate_dates
from contagraph.plans.shared import materialised
from contagraph.sources.csv_io import read_observations, write_csv
from contagraph.sources.fasta import fasta_records, write_fasta, write_fasta_file


class Stages:
    """Stages that last as long as their name says in `days`; the clock runs at `rate`."""

    def __init__(self, rate=0.0, latent=1.5, presymptomatic=0.75, delay=6.0, transmission=2.25):
        self.rate = rate
        for name, days in (("latent_periods", latent), ("presymptomatic_periods", presymptomatic), ("testing_delays", delay)):
            setattr(self, f"sample_{name}", lambda size=1, rng=None, days=days: np.full(size, days))
        self.rvs = lambda size=1, rng=None: np.full(size, transmission)

    def sample_clock_rate(self, size=1, rng=None):
        return np.full(size, self.rate)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def edges_of(spark, *pairs):
    return frame(spark, list(pairs), "parent string, child string")


def test_dates(spark):
    nodes = frame(spark, [(i, n) for i, n in enumerate(["a", "b", "c", "d", "alone"])], "idx int, node string")
    edges = edges_of(spark, ("a", "b"), ("b", "c"), ("a", "d"))
    got = {r["node"]: r for r in simulate_dates(Stages(), nodes, edges, 0.7).collect()}
    assert sum(r["sampled"] for r in got.values()) == 4  # 3.5, to even
    day = got["a"]["exposure_date"]
    assert day in range(30) and got["alone"]["exposure_date"] in range(30)
    assert {n: r["exposure_date"] - day for n, r in got.items() if n != "alone"} == {"a": 0, "b": 3.75, "c": 7.5, "d": 3.75}
    for n, r in got.items():
        assert r["seed"] == (n in ("a", "alone"))
        assert (r["date_infectious"], r["date_symptom_onset"], r["sample_date"]) == tuple(r["exposure_date"] + x for x in (1.5, 2.25, 8.25))
    for bad in (1.5, -0.1):
        with pytest.raises(ConfigurationError):
            simulate_dates(Stages(), nodes, edges, bad)
    weighed = nodes.withColumn("w", F.lit(1.0))
    for bad in (edges_of(spark, ("a", "b"), ("b", "a")), edges_of(spark, ("a", "b"), ("c", "b")), edges_of(spark, ("a", "a")), edges_of(spark, ("a", "z"))):
        with pytest.raises(ConfigurationError):
            simulate_dates(Stages(), nodes, bad)
    with pytest.raises(ConfigurationError):
        path_sums(weighed, edges_of(spark, ("a", "b"), ("b", "a")), "w")
    assert [exact_sample(nodes, x).where("sampled").count() for x in (0, 0.5, 0.7, 1)] == [0, 2, 4, 5]


def test_draws_ignore_partitioning(spark):
    from contagraph.functions.profiles import FromInfectiousness

    profile = FromInfectiousness(rng_seed=4)
    nodes = spark.range(2500).selectExpr("cast(id as int) as idx", "concat('n', id) as node")
    edges = spark.range(1, 2500).selectExpr("concat('n', cast((id - 1) / 3 as int)) as parent", "concat('n', id) as child")
    dated = [simulate_dates(profile, nodes.repartition(n), edges.repartition(n), seed=2) for n in (1, 7)]
    rows = [sorted(map(tuple, d.collect())) for d in dated]
    assert rows[0] == rows[1] and len({r[5] for r in rows[0]}) > 2400
    dated = materialised(dated[0], "dated")
    table = [sorted((r["idx"], tuple(r["stochastic"])) for r in simulate_sequences(profile, dated.repartition(n), edges, 50, seed=2).table.collect()) for n in (1, 7)]
    assert table[0] == table[1]


def test_deep_chain(spark):
    n = 40
    nodes = frame(spark, [(i, str(i), 1.0) for i in range(n)], "idx int, node string, w double")
    edges = frame(spark, [(str(i), str(i + 1)) for i in range(n - 1)], "parent string, child string")
    assert {int(r["node"]): r["total"] for r in path_sums(nodes, edges, "w").collect()} == {i: float(i) for i in range(n)}
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 4, (n, 45))
    steps = frame(spark, [(str(i), str(i - 1) if i else None, codes[i].tolist()) for i in range(n)], "node string, up string, codes array<int>").withColumn("words", pack(F.col("codes"))).drop("codes")
    for local in (None, 5):
        got = {int(r["node"]): r["c"] for r in along_tree(steps, ("words",), local).select("node", unpack(F.col("words"), 45).alias("c")).collect()}
        assert [got[i] for i in range(n)] == (np.cumsum(codes, 0) % 4).tolist()


@pytest.mark.parametrize("shape, n", [("chain", 10_000), ("star", 100_000), ("random", 3_000), ("forest", 3_000)])
def test_contraction_moves_few_rows(spark, shape, n):
    """Rows fall from round to round, and all rounds together hold a small multiple of the nodes."""
    rng = np.random.default_rng(5)
    up = {"chain": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: int(rng.integers(0, i)), "forest": lambda i: int(rng.integers(max(0, i - 40), i)) if i % 300 else None}[shape]
    parent = [None, *(up(i) for i in range(1, n))]
    nodes = spark.createDataFrame(pd.DataFrame({"node": range(n), "w": [float(i % 10) for i in range(n)]}))
    edges = spark.createDataFrame(pd.DataFrame([(p, c) for c, p in enumerate(parent) if p is not None], columns=["parent", "child"]))
    rounds = []
    got = {r["node"]: (r["root"], r["depth"], r["total"]) for r in path_sums(nodes, edges, "w", local=50, watch=rounds.append).collect()}
    want = {}
    for i, p in enumerate(parent):
        root, depth, total = want[p] if p is not None else (i, -1, -(i % 10))
        want[i] = (root, depth + 1, float(total + i % 10))
    assert got == want
    assert rounds == sorted(rounds, reverse=True) and len(set(rounds)) == len(rounds) and sum(rounds) <= 5 * n


def test_contraction_finds_cycles(spark):
    nodes = frame(spark, [(i, 1.0) for i in range(12)], "node int, w double")
    edges = frame(spark, [(i, i + 1) for i in range(5)] + [(11, 6), *((i, i + 1) for i in range(6, 11))], "parent int, child int")
    for local in (0, 3, 100):
        with pytest.raises(ConfigurationError, match="cycle"):
            path_sums(nodes, edges, "w", local=local)
    lone = frame(spark, [(i, 1.0) for i in range(4)], "node int, w double")
    assert path_sums(lone, edges.limit(0), "w", local=1).count() == 4 and path_sums(lone.limit(0), edges.limit(0), "w").count() == 0


def test_forest_is_checked_in_one_job(spark):
    nodes, edges = frame(spark, [(i, str(i)) for i in range(9)], "idx int, node string"), edges_of(spark, ("1", "2"), ("2", "3"))
    sc = spark.sparkContext
    sc.setJobGroup("forest", "forest")
    check_forest(nodes, edges)
    sc.setJobGroup("one query", "one query")
    nodes.groupBy("node").agg(F.count("*").alias("n")).agg(F.max("n")).first()
    sc.setJobGroup("rest", "rest")
    # adaptive execution runs the stages of one query as jobs of their own
    of = lambda group: len(sc.statusTracker().getJobIdsForGroup(group))
    assert of("forest") <= of("one query")


def test_siblings_of_a_large_family(spark):
    n = 3_000
    edges = spark.range(n).select(F.lit("p").alias("parent"), F.format_string("c%04d", "id").alias("child")).unionByName(edges_of(spark, ("q", "x"), ("q", "y"), ("q", "y"), ("r", "z")))
    pairs = siblings(edges.repartition(7), block=300)
    assert pairs.count() == n * (n - 1) // 2 + 1 == pairs.distinct().count() and pairs.where("a >= b").isEmpty()
    assert pairs.where("a = 'x'").collect() == [("x", "y")]
    # the tiles of one family are many, and none holds more than the pairs of two blocks
    tiles = pairs.groupBy(F.pmod(F.xxhash64("a"), F.lit(10)), F.pmod(F.xxhash64("b"), F.lit(10))).count().agg(F.max("count")).first()[0]
    assert tiles <= 2 * (n // 10 * 1.3) ** 2
    few = related(edges_of(spark, ("a", "b"), ("a", "c"), ("b", "d")))
    assert sorted(map(tuple, few.collect())) == sorted(t for x in (("a", "b"), ("a", "c"), ("b", "d"), ("b", "c")) for t in (x, x[::-1]))


@pytest.mark.parametrize("kind", ["small", "equal", "wide", "lopsided"])
def test_sample_by_any_key(spark, monkeypatch, kind):
    from contagraph.operators import trees

    monkeypatch.setattr(trees, "ROOM", 20)
    monkeypatch.setattr(trees, "BUCKETS", 16)
    rng = np.random.default_rng(8)
    n = 2_000
    keys = {"small": rng.permutation(n), "equal": np.full(n, -7), "wide": rng.integers(-(2**63), 2**63 - 1, n), "lopsided": np.where(rng.random(n) < 0.6, 5, rng.integers(-(2**62), 2**62, n))}[kind]
    if kind == "wide":
        keys[:2] = (-(2**63), 2**63 - 1)
    nodes = spark.createDataFrame([(f"n{i:05d}", int(k)) for i, k in enumerate(keys)], "node string, k long").repartition(6)
    for fraction in (0.0, 0.0004, 0.3333, 0.5, 0.9995, 1.0):
        got = {r["node"] for r in exact_sample(nodes, fraction, key=F.col("k")).where("sampled").collect()}
        assert got == {f"n{i:05d}" for i in sorted(range(n), key=lambda i: (keys[i], i))[: round(fraction * n)]}


def test_sequences(spark):
    nodes = frame(spark, [(0, "a", 1.0, 9.0), (1, "b", 4.0, 11.0), (2, "c", 30.0, 30.0)], "idx int, node string, exposure_date double, sample_date double")
    edges = edges_of(spark, ("a", "b"), ("a", "c"))
    differ = lambda x, y: sum(p != q for p, q in zip(x, y))
    for rate, b, c in ((0.0, 0, 0), (0.25, 3, 5), (0.5, 6, 10), (9.0, 40, 40)):  # branches of 5 + 7 and 21 + 0 days
        result = simulate_sequences(Stages(rate), nodes, edges, 40, return_raw=True)
        rows = {v: {r["node"]: r["codes"] for r in result["raw"][v].collect()} for v in result.raw}
        fixed = rows["deterministic"]
        assert (differ(fixed["a"], fixed["b"]), differ(fixed["a"], fixed["c"])) == (b, c)
        assert rows["stochastic"]["a"] == fixed["a"] and 0 < len(set(fixed["a"])) <= 4
        words = {v: {r["node"]: r["c"] for r in result.packed[v].select("node", unpack(F.col("words"), 40).alias("c")).collect()} for v in result.packed}
        assert words == rows and result.table.columns == ["idx", "node", "length", "deterministic", "stochastic"]
    assert list(result) == ["packed", "raw"] and len(result) == 2 and "raw" in result and simulate_sequences(Stages(), nodes, edges, 4).raw is None
    assert list(result.packed) == ["deterministic", "stochastic"] and "stochastic" in result.packed and set(result.to_dict()["raw"]) == set(result.raw)
    for bad in (0, True, 2.0):
        with pytest.raises(ConfigurationError):
            simulate_sequences(Stages(), nodes, edges, bad)
    for bad in (nodes.drop("sample_date"), nodes.withColumn("exposure_date", F.when(F.col("idx") != 2, F.col("exposure_date")))):
        with pytest.raises(SimulationError):
            simulate_sequences(Stages(), bad, edges, 4)


def test_changed_words():
    rng = np.random.default_rng(1)
    counts = [0, 1, 5, 20, 33, 70, 99]
    words = changed_words(rng, np.array(counts), 70)
    bits = np.unpackbits(words.astype(">u8").view(np.uint8)).reshape(len(counts), -1, 2)
    assert bits[:, :70].any(2).sum(1).tolist() == [0, 1, 5, 20, 33, 70, 70] and not bits[:, 70:].any()
    many = changed_words(rng, np.full(20000, 3), 9)
    hits = np.unpackbits(many.astype(">u8").view(np.uint8)).reshape(20000, -1, 2)[:, :9].any(2).sum(0)
    assert abs(hits / 20000 - 1 / 3).max() < 0.02


def test_packing_against_brute_force(spark):
    x = np.random.default_rng(1).integers(0, 4, (6, 97)).tolist()
    raw = frame(spark, [(i, str(i), r) for i, r in enumerate(x)], "idx int, node string, codes array<tinyint>")
    assert [r["c"] for r in raw.orderBy("idx").select(unpack(pack(F.col("codes")), 97).alias("c")).collect()] == x
    want = {(i, j): sum(a != b for a, b in zip(x[i], x[j])) for i in range(6) for j in range(6)}
    for blocks in (1, 2, 5):
        assert {(r["idx_a"], r["idx_b"]): r["distance"] for r in distance_matrix(packed(raw), blocks).collect()} == want
    with pytest.raises(ValueError):
        packed(frame(spark, [(0, "a", [4])], "idx int, node string, codes array<tinyint>"))
    with pytest.raises(TypeError):
        packed(frame(spark, [(0, "a", [1.0])], "idx int, node string, codes array<double>"))


def spread_out(pairs):
    """Whether no side is broadcast, and the pairs are made in more tasks than the tables' scans have."""
    return "Broadcast" not in pairs._jdf.queryExecution().toString() and pairs.rdd.getNumPartitions() > 1


def test_pairs_of_small_tables_are_spread(spark):
    n, length = 60, 70
    x = np.random.default_rng(2).integers(0, 4, (n, length))
    rows = packed(frame(spark, [(i, str(i), r) for i, r in enumerate(x.tolist())], "idx int, node string, codes array<tinyint>").coalesce(1))
    pairs = hamming_pairs(rows, 3, keep=("node",))
    assert spread_out(pairs) and "zip_with" not in pairs._jdf.queryExecution().toString()
    want = {(i, j): (int((x[i] != x[j]).sum()), str(i), str(j)) for i in range(n) for j in range(i + 1, n)}
    got = pairs.collect()
    assert len(got) == len(want) and {(r["idx_a"], r["idx_b"]): (r["distance"], r["node_a"], r["node_b"]) for r in got} == want


def test_matrix_is_made_in_one_pass(spark):
    x = np.random.default_rng(3).integers(0, 4, (40, 33))
    rows = packed(frame(spark, [(i, str(i), r) for i, r in enumerate(x.tolist())], "idx int, node string, codes array<tinyint>").coalesce(1))
    matrix = distance_matrix(rows, 3)
    plan = matrix._jdf.queryExecution().executedPlan().toString()
    assert spread_out(matrix) and "Union" not in plan and plan.count("SortMergeJoin") == 1
    got = matrix.collect()
    assert len(got) == 1600 and {(r["idx_a"], r["idx_b"]): r["distance"] for r in got} == {(i, j): int((x[i] != x[j]).sum()) for i in range(40) for j in range(40)}


def test_properties_are_added_up_where_pairs_meet(spark):
    from contagraph.plans.queries import QUERIES

    found = QUERIES["outbreak_properties"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and not any(f in plan for f in ("zip_with", "arrays_overlap", "bround"))
    assert found.first()["in_range"]


def test_properties_make_no_row_of_a_pair(spark):
    from contagraph.plans.queries import QUERIES

    plan = QUERIES["outbreak_properties"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "FlatMapGroupsInArrow" in plan


@pytest.mark.parametrize("odd, in_tiles", [("", True), ("unlisted parent", True), ("null dates", True), ("no dates", True), ("one case", True), ("two parents", False), ("listed twice", False), ("no cases", False), ("lengths", False), ("long", False), ("no name", False), ("no bases", False)])
def test_sums_are_those_of_the_pair_table(spark, odd, in_tiles):
    n, rng = {"one case": 1, "no cases": 0}.get(odd, 41), np.random.default_rng(12)
    words = lambda i: [] if odd == "no bases" else rng.integers(-(2**63), 2**63 - 1, 40 if odd == "long" else 3 + (odd == "lengths" and i == 5)).tolist()
    name = lambda i: None if odd == "no name" and i == 3 else "n7" if odd == "listed twice" and i == 8 else f"n{i}"
    seq = frame(spark, [(i, name(i), words(i), words(i)) for i in range(n)], "idx int, node string, deterministic array<bigint>, stochastic array<bigint>")
    day = lambda i: None if odd == "no dates" or odd == "null dates" and i % 5 == 0 else float(rng.integers(0, 99)) / 4
    nodes = frame(spark, [(f"n{i}", None if i == 9 else bool(i % 4), day(i)) for i in range(n)], "node string, sampled boolean, sample_date double")
    links = [(f"n{i // 3}", f"n{i}") for i in range(1, n)] + ([("n20", "n7")] if odd == "two parents" else [])
    links = [("elsewhere", c) if odd == "unlisted parent" and p in ("n2", "n5") else (p, c) for p, c in links]
    days = F.col("SamplingDateDistanceDays")
    table = pair_case_table(seq, nodes, edges_of(spark, *links))
    ends = [f(c) for c in ("DeterministicDistance", "StochasticDistance", "SamplingDateDistanceDays") for f in (F.min, F.max)]
    want = tuple(table.agg(F.count("*"), F.count_if("IsRelated"), F.count_if("BothSampled"), *ends, F.min(days == F.floor(days))).first())
    assert want[0] == n * (n - 1) // 2
    for blocks in (None, 1, 3):
        sums = pair_sums(seq, nodes, edges_of(spark, *links), blocks)
        assert str(tuple(sums.first())) == str(want)
        assert ("FlatMapGroupsInArrow" in sums._jdf.queryExecution().executedPlan().toString()) == in_tiles


@pytest.mark.parametrize("twice", [False, True])
def test_pair_table_of_a_small_table_is_spread(spark, twice):
    """With a parent each, pairs are compared in compiled code; with several, by their arrays. Days are rounded as bround() does."""
    n, rng = 40, np.random.default_rng(8)
    codes = rng.integers(0, 4, (2, n, 70))
    parents = {i: {i // 3} for i in range(1, n)} | ({7: {1, 30}, 9: {30}} if twice else {})
    dates = rng.choice([0.5, 1.0, 2.5, 3.0, 0.49999999999999994, 1e17], n)
    seq = frame(spark, [(i, f"n{i}", codes[0][i].tolist(), codes[1][i].tolist()) for i in range(n)], "idx int, node string, d array<int>, s array<int>").select("idx", "node", pack(F.col("d")).alias("deterministic"), pack(F.col("s")).alias("stochastic"))
    nodes = frame(spark, [(f"n{i}", bool(i % 4), float(dates[i])) for i in range(n)], "node string, sampled boolean, sample_date double")
    pairs = pair_case_table(seq.coalesce(1), nodes, edges_of(spark, *[(f"n{p}", f"n{c}") for c, ps in parents.items() for p in ps]), 2, with_idx=True)
    assert spread_out(pairs) and ("arrays_overlap" in pairs._jdf.queryExecution().toString()) == twice
    got = {(r[0], r[1]): tuple(r)[4:] for r in pairs.collect()}
    above = [parents.get(i, set()) for i in range(n)]
    assert got == {(i, j): (i in above[j] or j in above[i] or bool(above[i] & above[j]), bool(i % 4 and j % 4), *(int((c[i] != c[j]).sum()) for c in codes), float(round(abs(dates[i] - dates[j])))) for i in range(n) for j in range(i + 1, n)}


@pytest.mark.parametrize("words, distances", [([[1], [2], [4]], [1, 2, 2]), ([[1], [2], [4, 5]], [1, None, None]), ([[1], [None], [4]], [None, 2, None]), ([[1], None, [4]], [None, 2, None]), ([[], [], []], [0, 0, 0]), ([[0] * 70 + [k] for k in (1, 2, 4)], [1, 2, 2])])
def test_distances_of_odd_words(spark, words, distances):
    got = hamming_pairs(frame(spark, list(enumerate(words)), "idx int, words array<bigint>")).orderBy("idx_a", "idx_b").collect()
    assert [tuple(r) for r in got] == list(zip((0, 0, 1), (1, 2, 2), distances))


def test_pair_table_against_brute_force(spark):
    rng = np.random.default_rng(6)
    n, length = 23, 50
    codes = rng.integers(0, 4, (2, n, length))
    parent = {i: int(rng.integers(0, i)) for i in range(1, n) if i % 7}
    dates = [None if i == 4 else float(rng.integers(0, 40)) / 2 for i in range(n)]
    sampled = [None if i == 9 else bool(i % 3) for i in range(n)]
    seq = frame(spark, [(10 * i, f"n{i}", codes[0][i].tolist(), codes[1][i].tolist()) for i in range(n)], "idx int, node string, d array<int>, s array<int>").select("idx", "node", pack(F.col("d")).alias("deterministic"), pack(F.col("s")).alias("stochastic"))
    nodes = frame(spark, [(f"n{i}", sampled[i], dates[i]) for i in range(n)], "node string, sampled boolean, sample_date double")
    edges = frame(spark, [(f"n{p}", f"n{c}") for c, p in parent.items()], "parent string, child string")
    want = []
    for i in range(n):
        for j in range(i + 1, n):
            kin = parent.get(j) == i or parent.get(i) == j or (i in parent and parent.get(i) == parent.get(j))
            days = None if dates[i] is None or dates[j] is None else float(round(abs(dates[i] - dates[j])))
            want.append((10 * i, 10 * j, f"n{i}", f"n{j}", kin, bool(sampled[i] and sampled[j]), *(int((c[i] != c[j]).sum()) for c in codes), days))
    for blocks in (None, 1, 3):
        got = pair_case_table(seq, nodes, edges, blocks, with_idx=True).orderBy("idx_a", "idx_b").collect()
        assert [tuple(None if x != x else x for x in r) for r in got] == want
    one = {v: seq.select("idx", "node", F.col(v).alias("words")) for v in ("deterministic", "stochastic")}
    assert [tuple(None if x != x else x for x in r) for r in pair_case_table(one, nodes, edges, with_idx=True).orderBy("idx_a", "idx_b").collect()] == want
    bare = pair_case_table(seq, nodes.select("node"), edges).collect()
    assert len(bare) == len(want) and not any(r["BothSampled"] for r in bare) and all(r["SamplingDateDistanceDays"] != r["SamplingDateDistanceDays"] for r in bare)


def test_fasta(spark, tmp_path):
    codes = np.random.default_rng(5).integers(0, 4, (3, 230))
    text = ["".join("ACGT"[c] for c in x) for x in codes]
    words = packed(frame(spark, [(i, f"s{i}", x.tolist()) for i, x in enumerate(codes)], "idx int, node string, codes array<tinyint>"))
    want = [f">s{i}\n{t[:100]}\n{t[100:200]}\n{t[200:]}" for i, t in enumerate(text)]
    assert [r["record"] for r in fasta_records(words).orderBy("idx").collect()] == want
    write_fasta_file(words, str(tmp_path / "x.fa"))
    assert (tmp_path / "x.fa").read_text() == "\n".join(want) + "\n"
    write_fasta(words, f"file://{tmp_path}/many", partitions=2)
    assert "".join(p.read_text() for p in sorted((tmp_path / "many").glob("part-*"))) == "\n".join(want) + "\n"


def test_csv(spark, tmp_path):
    given = tmp_path / "in.csv"
    given.write_text('id,genetic_distance,note,sample_time_difference\n1,2,"a ""quoted"" word, and\ntwo lines", 3.5\n2,NaN,,\n3,n/a,plain,-1e1\n')
    rows = read_observations(spark, str(given), keep_order=True)
    got = [tuple(r)[:4] for r in rows.orderBy("csv_row").collect()]
    assert got[0] == ("1", 2.0, 'a "quoted" word, and\ntwo lines', 3.5) and got[2] == ("3", got[2][1], "plain", -10.0) and got[2][1] != got[2][1]
    write_csv(rows, str(tmp_path / "out.csv"))
    again = pd.read_csv(tmp_path / "out.csv")
    assert again.columns.tolist() == ["id", "genetic_distance", "note", "sample_time_difference"] and again.note[0] == got[0][2] and again.sample_time_difference.tolist()[::2] == [3.5, -10.0]
    (tmp_path / "bad.csv").write_text("sample_time_difference\n1\n")
    with pytest.raises(ConfigurationError):
        read_observations(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "text.csv").write_text("sample_time_difference,genetic_distance\nlong,2\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_observations(spark, str(tmp_path / "text.csv")).collect()


def test_csv_as_others_write_it(spark, tmp_path):
    given = tmp_path / "in.csv"
    given.write_bytes(b'note,sample_time_difference,note,genetic_distance,note\r\n"a\r\nb",#N/A,,<NA>,NA\r\n\r\nx,-nan,"""",-1.#IND,"c,d"\r\n,1e2,"\n\n",null,\r\n')
    rows = read_observations(spark, str(given), keep_order=True).orderBy("csv_row").collect()
    assert rows[0].__fields__ == ["note", "sample_time_difference", "note.1", "genetic_distance", "note.2", "csv_row"]
    clean = [tuple("nan" if isinstance(v, float) and v != v else v for v in r[:5]) for r in rows]
    assert clean == [("a\r\nb", "nan", None, "nan", "NA"), ("x", "nan", '"', "nan", "c,d"), (None, 100.0, "\n\n", "nan", None)]
    (tmp_path / "open.csv").write_text('sample_time_difference,genetic_distance\n1,2\n"3,4\n')
    with pytest.raises(ConfigurationError):
        read_observations(spark, str(tmp_path / "open.csv"))


def test_csv_in_splits(spark, tmp_path):
    """Quoted line feeds wherever a split may fall; the file written back is the same, byte for byte."""
    import csv
    import random

    r = random.Random(1)
    words = ["plain", "a,b", 'say "x"', "two\nlines", "\n", "many\n" * 30, '"\n"', "é" * 9]
    path = tmp_path / "in.csv"
    rows = [[i, r.choice(words), i / 8, r.choice(words) + str(i), float(i % 9)] for i in range(3000)]
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(["id", "note", "sample_time_difference", "text", "genetic_distance"])
        w.writerows(rows)
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.text(str(path)).rdd.getNumPartitions() >= 20
        found = read_observations(spark, str(path), keep_order=True)
        got = [tuple(x)[:5] for x in found.orderBy("csv_row").collect()]
    finally:
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.set(k, held[k]) if k in held else spark.conf.unset(k)
    assert got == [(str(i), a, t, b, g) for i, a, t, b, g in rows]
    write_csv(found, str(tmp_path / "out.csv"))
    assert (tmp_path / "out.csv").read_bytes() == path.read_bytes()


def test_cli(spark, tmp_path, capsys):
    good, bad = tmp_path / "in.csv", tmp_path / "bad.csv"
    good.write_text("id,sample_time_difference,genetic_distance\na,4.5,3\nb,,2\nc,0.5,7\n")
    bad.write_text("time,distance\n4,3\n")
    cli.main([str(good), "-o", str(tmp_path / "out.csv"), "--mc-samples", "200", "--maximum-depth", "0", "--seed", "1"])
    lines = (tmp_path / "out.csv").read_text().splitlines()
    assert lines[0] == "id,sample_time_difference,genetic_distance,linkage_score" and [x[0] for x in lines[1:]] == ["a", "b", "c"] and lines[2].endswith(",0.0")
    cli.main([str(good), "--mc-samples", "100", "--maximum-depth", "0", "--mutation-process", "deterministic"])
    assert len(capsys.readouterr().out.splitlines()) == 4
    for args, code in (([str(bad)], 1), ([str(good), "--mutation-process", "odd"], 2)):
        with pytest.raises(SystemExit) as e:
            cli.main(args)
        assert e.value.code == code


def test_registered_queries(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
