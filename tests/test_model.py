import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contagraph.exceptions import ConfigurationError, ContagraphError, ScenarioError, SimulationError
from contagraph.functions.columns import Steps
from contagraph.functions.gamma import gamma_cdf
from contagraph.functions.parameters import NaturalHistory
from contagraph.functions.profiles import FromInfectiousness, FromSymptomOnset, TransmissionProfile
from contagraph.operators.draws import draw_frame, genetic_draws, scenario_draws
from contagraph.operators.scenarios import Scenario, enumerate_scenarios, resolve_targets, scenario_frame
from contagraph.operators import scorer
from contagraph.operators.scorer import GENETIC, TIME, LinkageModel, PairScorer, compatibility_from_percentile, compatibility_score, ecdf, label_percentiles, percentile_score, percentiles


def test_parameters():
    p = NaturalHistory()
    assert p.presymptomatic_shape == pytest.approx(2.427)
    assert p.infectiousness_normalisation == pytest.approx(0.125447, abs=1e-6)
    assert p.presymptomatic_transmission_fraction == pytest.approx(0.660955, abs=1e-6)
    assert NaturalHistory(**p.to_dict()) == p and len(p.to_dict()) == 11
    with pytest.raises(TypeError):
        NaturalHistory(genome_length=True)
    with pytest.raises(TypeError):
        NaturalHistory(relaxation="x")
    for bad in ({"latent_shape": 5.807}, {"relaxation": -0.1}, {"substitution_rate": 0}):
        with pytest.raises(ValueError):
            NaturalHistory(**bad)
    assert NaturalHistory(relaxation=0).relaxation == 0


def test_errors():
    assert issubclass(ScenarioError, (ContagraphError, ValueError)) and issubclass(ConfigurationError, ValueError) and issubclass(SimulationError, RuntimeError)


def test_scenarios(spark):
    assert Scenario.parse("\t Ca(04,01)\n").label() == "ca(4,1)" and str(Scenario.parse("ad(11)")) == "ad(11)" and Scenario(" AD", 2).label() == "ad(2)"
    for bad in ("ad(1,2)", "ca(3)", "tree(1)", "ca(2, 2)", "ad(-1)", "", None):
        with pytest.raises(ScenarioError):
            Scenario.parse(bad)
    assert [len(enumerate_scenarios(m)) for m in range(5)] == [2, 5, 9, 14, 20]
    assert [r["label"] for r in scenario_frame(spark, 4).orderBy("ord").collect()] == [s.label() for s in enumerate_scenarios(4)]
    labels = [s.label() for s in enumerate_scenarios(0)]
    assert resolve_targets(["ca(0,0)", "ad(0)", "ad(0)"], labels) == ("ad(0)", "ca(0,0)")
    with pytest.raises(ScenarioError):
        resolve_targets("ad(3)", labels)


class Ramp(TransmissionProfile):
    """Density x / 18 on 0 to 6."""

    slope = 1 / 18

    def pdf(self, days):
        return np.asarray(days, float) * self.slope


class Flat(Ramp):
    slope = 0.0


class Wild(Ramp):
    slope = float("inf")


def test_profiles():
    ramp = Ramp(grid_min_days=0, grid_max_days=6, grid_points=7)
    assert ramp.cdf([-1, 0, 3, 3.5, 6, 9]).tolist() == pytest.approx([0, 0, 9 / 36, 12.5 / 36, 1, 1])
    assert Ramp(grid_max_days=6, grid_points=4001).mean() == pytest.approx(4, abs=1e-5)
    with np.errstate(invalid="ignore"):
        for kind in (Flat, Wild):  # no usable mass: a straight line
            p = kind(grid_min_days=-1, grid_max_days=7, grid_points=9)
            assert p.cdf([-1, 1, 4.5, 7]).tolist() == [0, 0.25, 0.6875, 1] and math.isnan(p.mean())
    for bad in ({"grid_min_days": 8, "grid_max_days": 8}, {"grid_points": 0}):
        with pytest.raises(ConfigurationError):
            Ramp(**bad)
    assert repr(ramp).startswith("Ramp(NaturalHistory(") and repr(ramp).endswith(", grid_min_days=0, grid_max_days=6, grid_points=7)")
    assert gamma_cdf(2.0, 0.5, 1.0) == pytest.approx(math.erf(math.sqrt(2)), abs=1e-14)
    p = FromInfectiousness(rng_seed=3)
    assert p.mean() == pytest.approx(2.76984, abs=1e-4) and p.rvs(20000).mean() == pytest.approx(p.mean(), abs=0.1)
    q = FromSymptomOnset()
    assert q.mean() == pytest.approx(-0.15749, abs=1e-4)
    strict = FromInfectiousness(NaturalHistory(substitution_rate=7.3e-4, relaxation=0, genome_length=5000))
    assert np.allclose(strict.sample_clock_rate((4, 2)), 0.01) and np.allclose(strict.expected_mutations([0.0, 250.0]), [0, 2.5])
    with pytest.raises(NotImplementedError):
        TransmissionProfile().pdf(1)


def test_gamma_of_any_shape():
    # at its shape a, the distribution function is 1/2 + (1/3 + 1/(540 a) - 25/(6048 a**2) + ...) / sqrt(2 pi a)
    for shape in (1e2, 1e3, 1e4, 1e5, 1e6, 1e7):
        near = 0.5 + (1 / 3 + 1 / (540 * shape) - 25 / (6048 * shape**2)) / math.sqrt(2 * math.pi * shape)
        assert gamma_cdf(shape, shape, 1.0) == pytest.approx(near, abs=1e-9)
        x = shape + np.linspace(-5, 5, 41) * math.sqrt(shape)
        got = gamma_cdf(x, shape, 1.0)
        assert (np.diff(got) > 0).all() and got[0] < 1e-5 and got[-1] > 1 - 1e-5
        # P(a + 1, x) = P(a, x) - x**a exp(-x) / gamma(a + 1)
        step = np.exp(shape * np.log(x) - x - math.lgamma(shape + 1))
        assert np.allclose(gamma_cdf(x, shape + 1, 1.0), got - step, atol=1e-8 * shape**0.5)
    with pytest.raises(ValueError):
        gamma_cdf(1.0, 1e11, 1.0)


class Counting:
    """Samplers without a generator: each call goes on where the last one ended. Mutations follow a rule of its own."""

    def __init__(self):
        self.calls, self.at = [], 0.0

    def _next(self, name, size):
        self.calls.append((name, size))
        n = int(np.prod(size))
        out = self.at + np.arange(n).reshape(size)
        self.at += n
        return out

    def sample_incubation_periods(self, size=1):
        return self._next("incubation", size)

    def sample_testing_delays(self, size=1):
        return self._next("delay", size)

    def sample_generation_intervals(self, size=1):
        return self._next("generation", size)

    def sample_clock_rate(self, size=1):
        raise AssertionError("the profile has its own rule")

    def expected_mutations(self, days):
        return np.asarray(days) * 3 + 1


def test_any_object_with_samplers_is_a_profile(spark):
    profile = Counting()
    model = LinkageModel(spark, profile, maximum_depth=0, mc_samples=3, mutation_process="deterministic")
    rows = {(r["label"], r["draw_id"]): (r["time_draw"], r["branch_draw"], r["genetic_draw"]) for r in model.draws.collect()}
    # direct: incubations 0-2 and 3-5, delays 6-8 and 9-11, a generation 12-14; shared source: the same from 15 on, and a second path
    assert [rows["ad(0)", i] for i in range(3)] == [(18.0 + i, 18.0 + i, 55.0 + 3 * i) for i in range(3)]
    assert [rows["ca(0,0)", i] for i in range(3)] == [(9.0, 27 + 30 + 15 + 18 + 21 + 24 + 6.0 * i, (135 + 6.0 * i) * 3 + 1) for i in range(3)]
    assert [c for c, _ in profile.calls] == ["incubation", "incubation", "delay", "delay", "generation"] * 2 + ["generation"]
    assert model.score_target(19.0, 58.0, "ad(0)") == pytest.approx((1 - 2 * abs(2 / 3 - 0.5)) ** 2)

    class Short:
        def sample_incubation_periods(self, size=1):
            return np.zeros(size)

    with pytest.raises(SimulationError):
        LinkageModel(spark, Short(), maximum_depth=0, mc_samples=3)


class Recorded:
    """Samplers that replay given numbers, one list for each call; the clock runs at its own list of rates."""

    def __init__(self, incubation, delay, generations, rates=()):
        self.calls = {"incubation": iter(incubation), "delay": iter(delay), "generations": iter(generations)}
        self.rates = np.array(rates, float)

    def _next(self, name, size):
        return np.array(next(self.calls[name]), float).reshape(size)

    def sample_incubation_periods(self, size=1):
        return self._next("incubation", size)

    def sample_testing_delays(self, size=1):
        return self._next("delay", size)

    def sample_generation_intervals(self, size=1):
        return self._next("generations", size)

    def sample_clock_rate(self, size=1):
        return self.rates[:size]


def test_draws_by_hand(spark):
    # direct through one unseen case: two generations, j's stages added, i's taken off; a branch never ends below 0
    given = Recorded([[7, 3, 9], [4, 6, 1]], [[1, 2, 5], [3, 0, 1]], [[[6, 8, 2], [5, 1, 4]]])
    time, branch = scenario_draws(given, Scenario.parse("ad(1)"), 3)
    assert time.tolist() == [10, 10, -6] and branch.tolist() == [10, 10, 0]
    assert genetic_draws(Recorded([], [], [], [0.5, 0.25, 9]), branch, " Deterministic ").tolist() == [5, 2.5, 0]
    # shared source: the branch holds both paths and all stages
    given = Recorded([[7, 3], [4, 6]], [[1, 2], [3, 0]], [[[6, 8]], [[5, 1], [2, 2], [9, 3]]])
    time, branch = scenario_draws(given, Scenario.parse("ca(0,2)"), 2)
    assert time.tolist() == [16 - 6 + 7 - 8, 6 - 8 + 6 - 5] and branch.tolist() == [16 + 6 + 15, 6 + 8 + 11]
    p = FromInfectiousness(rng_seed=1)
    a, b = (draw_frame(spark, p, 1, 2500, seed=5).orderBy("ord", "draw_id").toPandas() for _ in range(2))
    assert a.equals(b) and len(a) == 5 * 2500
    assert (a.genetic_draw == a.genetic_draw.round()).all()


def test_failing_draws_name_their_scenario(spark):
    class Broken(FromInfectiousness):
        def sample_generation_intervals(self, size=1, rng=None):
            if size[0] == 3:
                raise RuntimeError("no more")
            return super().sample_generation_intervals(size, rng)

    with pytest.raises(SimulationError, match=r"scenario (ad\(2\)|ca\(0,2\)|ca\(2,0\)) failed: no more"):
        LinkageModel(spark, Broken(rng_seed=1), maximum_depth=2, mc_samples=50)


# eight draws of one scenario and four of the other, in no order
OWN = [("ad(0)", t, g) for t, g in zip((3.5, -2, 0, 6, 6, 1, 9, 4), (0, 5, 2, 2, 7, 1, 0, 3))] + [("ca(0,0)", t, g) for t, g in zip((5, -1, 12, 5), (4, 4, 10, 6))]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(label, i, float(t), max(0.0, float(t)), float(g)) for i, (label, t, g) in enumerate(OWN)]
    draws = spark.createDataFrame(rows, "label string, draw_id int, time_draw double, branch_draw double, genetic_draw double")
    return LinkageModel(spark, FromInfectiousness(rng_seed=1), maximum_depth=0, mc_samples=4, draws=draws)




def test_scores(spark, model):
    # five of eight and three of four times are no larger; six of eight and two of four distances
    result = model.score_pair(5, 4)
    assert {k: tuple(v.to_dict().values()) for k, v in result.scenario_scores.items()} == {"ad(0)": (0.625, 0.75, 0.75, 0.5, 0.375), "ca(0,0)": (0.75, 0.5, 0.5, 1.0, 0.5)}
    assert result["target_compatibility"] == 0.875 and result["scenario_scores"]["ca(0,0)"]["compatibility"] == 0.5
    assert result.to_dict()["target"] == ["ad(0)", "ca(0,0)"] and list(result) == ["target", "target_labels", "target_compatibility", "scenario_scores"] and len(result) == 4 and "target" in result
    score = result.scenario_scores["ad(0)"]
    assert score["compatibility"] == 0.375 and len(score) == 5 and "time_percentile" in score and "x" not in score
    nan = float("nan")
    obs = spark.createDataFrame([(5.0, 4.0, "x"), (None, 4.0, "y"), (nan, 4.0, "z"), (5.0, None, "w"), (-9.0, 4.0, "below"), (99.0, 4.0, "above")], f"{TIME} double, {GENETIC} double, id string")
    assert {r["id"]: r["score"] for r in model.score_target(obs).collect()} == {"x": 0.875, "y": 0, "z": 0, "w": 0, "below": 0, "above": 0}
    assert model.scorer("ad(0)") is model.scorer([" AD(0)"]) is model.scorer("ad(00)") and model.score_grid([5.0, 4.5], [1.0, 2.5, 4.0]).count() == 6
    assert model.score_target(5, 4) == 0.875 and model.score_target(5, 4, "ad(0)") == 0.375 and model.score_target(nan, 4) == 0
    for bad in ([1.0], None, "5"):
        with pytest.raises(TypeError):
            model.score_pair(bad, 1.0)
        with pytest.raises(TypeError):
            model.score_target(bad, 1.0)
    with pytest.raises(ConfigurationError):
        LinkageModel(spark, model.profile, mutation_process="odd", draws=model.draws)
    with pytest.raises(ConfigurationError):
        model.scorer([])
    assert LinkageModel(spark, model.profile, mutation_process=" STOCHASTIC", maximum_depth=0, draws=model.draws).score_pair(5, 4).target_compatibility == 0.875


def test_other_draws(spark, model):
    only = model.draws.where("label = 'ad(0)'")
    moved = model.with_draws(model.draws.withColumn("time_draw", F.lit(5.0)))
    assert moved.score_pair(5, 4).target_compatibility == 0 and moved.score_pair(4.9, 4).target_compatibility == 0
    for most in (None, 0):
        with pytest.raises(SimulationError, match="ca\\(0,0\\)"):
            PairScorer(only, ("ad(0)", "ca(0,0)"), most)


def test_single_scores():
    assert percentile_score(5, [3.5, -2, 0, 6, 6, 1, 9, 4]) == 0.625 and percentile_score(float("nan"), [1.0, 2.0]) == 0
    assert compatibility_from_percentile(0.625) == 0.75 and compatibility_score(5, [5, -1, 12, 5]) == (0.75, 0.5)


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def percentiles_by_join(obs, draws, column, value):
    """By comparing every draw with every observation."""
    x = F.coalesce(F.col(column).cast("double"), F.lit(float("nan")))
    keyed = obs.withColumn("row", F.monotonically_increasing_id())
    both = keyed.join(draws.select(F.col("label").alias("l"), F.col(value).alias("v")), F.col("label") == F.col("l"))
    hit = F.when((F.col("v") <= x) & ~F.isnan(x), 1.0).otherwise(0.0)
    return both.groupBy("row", *obs.columns).agg(F.avg(hit).alias("percentile")).drop("row")


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_strategies_agree(spark, model):
    values = [(float(t), float(g)) for t in (-3, -2, 0, 1, 3.6, 5, 6, 9, 12, 40) for g in (-1, 0, 1.5, 4, 7, 10, 11)] + [(float("nan"), 1.0), (0.0, float("nan"))]
    obs = spark.createDataFrame([*values, (None, 4.0)], f"{TIME} double, {GENETIC} double")
    labelled = obs.withColumn("label", F.explode(F.array(F.lit("ad(0)"), F.lit("ca(0,0)"))))
    assert rows_of(percentiles(labelled, model.draws, TIME, "time_draw").select(TIME, GENETIC, "label", "percentile")) == rows_of(percentiles_by_join(labelled, model.draws, TIME, "time_draw").select(TIME, GENETIC, "label", "percentile"))
    one, other = PairScorer(model.draws, ("ad(0)", "ca(0,0)")), PairScorer(model.draws, ("ad(0)", "ca(0,0)"), constant_draws=0)
    assert one.constant and not other.constant and "Python" not in plan_of(one.score(obs)) + plan_of(other.score(obs)) + plan_of(one.breakdown(obs))
    assert rows_of(one.breakdown(obs)) == rows_of(other.breakdown(obs))
    assert rows_of(one.score(obs)) == rows_of(other.score(obs))
    assert rows_of(one.score(obs, out=GENETIC)) == rows_of(other.score(obs, out=GENETIC))
    for t, g in ((5.0, 4.0), (-2.0, 0.0), (float("nan"), 4.0)):
        assert one.shares(t, g) == other.shares(t, g) and one.score_values(t, g) == other.score_values(t, g)


def test_ecdf_of_many_draws(spark):
    """Against NumPy: 20,000 draws of two labels, half of one label's draws equal, observations mostly of one value."""
    rng = np.random.default_rng(3)
    x = {"a": np.concatenate([np.full(5000, 2.5), rng.normal(0, 10, 5000)]), "b": np.round(rng.normal(5, 3, 10000), 1)}
    draws = spark.createDataFrame(pd.DataFrame([(k, v) for k, a in x.items() for v in a], columns=["label", "v"]))
    asked = [2.5] * 500 + [-100.0, 100.0, 0.0, -0.0, *rng.normal(0, 12, 200).round(1).tolist()]
    obs = spark.createDataFrame([(k, v) for k in x for v in asked], "label string, asked double")
    got = sorted((r["label"], r["asked"], r["percentile"]) for r in percentiles(obs, draws, "asked", "v").collect())
    assert got == sorted((k, v, float((a <= v).mean())) for k, a in x.items() for v in asked)
    table = ecdf(draws, "v").toPandas()
    for k, a in x.items():
        values, counts = np.unique(a, return_counts=True)
        mine = table[table.label == k].sort_values("value")
        assert mine.value.tolist() == values.tolist() and mine.cum_count.tolist() == np.cumsum(counts).tolist() and set(mine.n) == {10000}
    assert percentiles(obs.limit(0), draws, "asked", "v").count() == 0
    alone = obs.where("label = 'a'").drop("label")
    wide = label_percentiles(alone, draws, ["b", "none", "a"], "asked", "v").collect()
    assert len(wide) == len(asked)
    for r in wide:
        assert r["percentiles"] == [float((x["b"] <= r["asked"]).mean()), None, float((x["a"] <= r["asked"]).mean())]


def test_a_value_that_half_of_the_rows_share(spark, monkeypatch):
    """Its rows are split among tasks, on the merged path; no row of any table grows with the draws."""
    draws = spark.range(40_000).select(F.lit("ad(0)").alias("label"), (F.col("id") % 9000 / 7.0).alias("time_draw"), (F.col("id") % 500).cast("double").alias("genetic_draw"))
    obs = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, 3.0).otherwise(F.col("id") / 100.0).alias(TIME), (F.col("id") % 700).cast("double").alias(GENETIC), F.repeat(F.lit("x"), 60).alias("note"))
    scorer = PairScorer(draws, ("ad(0)",), constant_draws=0)
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        scored = scorer.score(obs)
        plan = plan_of(scored)
        sizes = sorted(r["n"] for r in scored.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan and "Python" not in plan and sum(sizes) == 200_000
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
    some = obs.limit(400)
    assert rows_of(scorer.score(some)) == rows_of(PairScorer(draws, ("ad(0)",)).score(some))


def test_columns_that_bisect(spark):
    x = np.array([-2.0, 0.0, 0.1, 3.0, 1e300])
    asked = [-3.0, -2.0, -0.0, 0.05, 0.1, 2.9999999999999996, 3.0, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in asked], "x double")
    steps = Steps(x, np.array([1, 2, 4, 5, 10]))
    got = [r[0] for r in df.select(steps.share(F.col("x"))).collect()]
    assert got == [0.0, 0.1, 0.2, 0.2, 0.4, 0.4, 0.5, 1.0, 1.0, 1.0] and [steps.of(v) for v in asked[:-1]] == got[:-1]
    assert [r[0] for r in df.selectExpr(f"{steps.share_sql('x')} as s").collect()] == got
    profile = Ramp(grid_min_days=0, grid_max_days=6, grid_points=130)
    at = spark.createDataFrame([(float(v),) for v in np.linspace(-1, 7, 333)] + [(None,), (float("nan"),)], "x double")
    rows = at.select("x", profile.cdf_column(F.col("x")).alias("c"), profile.quantile_column(F.col("x") / 6).alias("q")).collect()
    for r in rows[:-2]:
        assert r["c"] == pytest.approx(float(profile.cdf(r["x"])), abs=1e-14) and r["q"] == pytest.approx(float(profile.quantile(r["x"] / 6)), abs=1e-12)
    assert all(r["c"] is None and r["q"] is None for r in rows[-2:])


@pytest.mark.parametrize("most", [None, 0])
def test_stream(spark, model, tmp_path, monkeypatch, most):
    from contagraph.streaming.scoring import register_score, score_stream

    if most is not None:
        monkeypatch.setattr(scorer, "CONSTANT_DRAWS", most)
    fresh = model.with_draws(model.draws)
    spark.createDataFrame([(5.0, 4.0), (None, 4.0), (99.0, 1.0)], f"{TIME} double, {GENETIC} double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f"{TIME} double, {GENETIC} double").parquet(str(tmp_path / "in"))
    for name, df in (("scored", score_stream(stream, fresh)), ("broken_down", fresh.score_pairs(stream))):
        q = df.writeStream.format("memory").queryName(f"{name}{most}").start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["score"] for r in spark.table(f"scored{most}").collect()) == [0, 0, 0.875]
    assert sorted(r["compatibility"] for r in spark.table(f"broken_down{most}").collect()) == [0, 0, 0, 0, 0.375, 0.5]
    # functions and columns bisect constants, however many draws there are
    register_score(fresh)
    assert spark.sql("select linkage_score(5D, 4D) s, linkage_score(null, 4D) t").first()[:] == (0.875, 0)
    assert spark.range(1).select(fresh.scorer().score_column(F.lit(5.0), F.lit(4.0)).alias("s")).first()["s"] == 0.875
