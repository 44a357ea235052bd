"""Compatibility of observed pairs with scenarios: percentiles among the scenarios' draws, on the time and genetic axes."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contagraph.exceptions import ConfigurationError, ScenarioError, SimulationError
from contagraph.functions.columns import Steps, compatibility, known
from contagraph.functions.profiles import FromInfectiousness
from contagraph.operators.draws import draw_frame
from contagraph.operators.draws import mutation_process as canonical_process
from contagraph.operators.scenarios import Scenario, enumerate_scenarios, resolve_targets
from contagraph.plans.shared import materialised

#: Up to so many distinct draws are constants of the plan; more become a table that observations are merged with. The
#: results are the same either way.
CONSTANT_DRAWS = 200_000
TIME, GENETIC = "sample_time_difference", "genetic_distance"
AXES = (("time", TIME, "time_draw"), ("genetic", GENETIC, "genetic_draw"))


class EcdfTable:
    """The distribution functions of one column of the draws, by label: counts has label, v, c for each distinct value."""

    def __init__(self, draws: DataFrame, value: str, label: str = "label") -> None:
        self.counts = materialised(draws.groupBy(F.col(label).alias("label"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c")), "ecdf-counts")

    @classmethod
    def of(cls, counts: DataFrame) -> EcdfTable:
        """From counts (label, v, c) that are kept already."""
        out = cls.__new__(cls)
        out.counts = counts
        return out

    def totals(self) -> DataFrame:
        """label, n: all of its draws."""
        return self.counts.groupBy("label").agg(F.sum("c").alias("n"))

    def rows(self) -> DataFrame:
        """label, value, cum_count, n: one row for each distinct value."""
        cum = _running(self.counts.select("label", "v", "c", F.lit(0).alias("asked")))
        return cum.join(self.totals(), "label").select("label", F.col("v").alias("value"), F.col("cum").alias("cum_count"), "n")

    def percentile(self, asked: DataFrame, value: str, out: str) -> DataFrame:
        """Distinct asked (label, value) with the share of the label's draws that are no larger, as `out`; 0 for NaN.

        Rows of a label without draws go.
        """
        events = self.counts.select("label", "v", "c", F.lit(0).alias("asked")).unionByName(asked.select("label", F.col(value).alias("v"), F.lit(0).cast("long").alias("c"), F.lit(1).alias("asked")))
        found = _running(events).where(F.col("asked") == 1).join(self.totals(), "label")
        return found.select("label", F.col("v").alias(value), F.when(F.isnan("v"), 0.0).otherwise(F.col("cum") / F.col("n")).alias(out))


def _running(events: DataFrame) -> DataFrame:
    """events (label, v, c, asked) with cum: the sum of c over the label's rows of lower values, and equal ones not asked.

    A sorted merge in parts: rows are cut into ranges of v at sampled quantiles, as many as the session has shuffle
    partitions; each range adds up in order, from what the ranges below it hold. No row grows with the draws.
    """
    cut = materialised(events.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "ecdf-ranges")
    inside = cut.withColumn("inside", F.sum("c").over(Window.partitionBy("part", "label").orderBy("v", "asked")))
    # a row for each range and label
    carried = F.sum("held").over(Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = cut.groupBy("part", "label").agg(F.sum("c").alias("held")).select("part", "label", F.coalesce(carried, F.lit(0)).alias("before"))
    return inside.join(before, ["part", "label"]).select("label", "v", "c", "asked", (F.col("before") + F.col("inside")).alias("cum"))


def ecdf(draws: DataFrame, value: str, label: str = "label") -> DataFrame:
    """label, value, cum_count, n: one row for each distinct value."""
    return EcdfTable(draws, value, label).rows()


def percentiles(obs: DataFrame, draws: DataFrame | EcdfTable, column: str, value: str) -> DataFrame:
    """obs rows (with `label`) and percentile; 0 for NaN and null.

    Each label and distinct value of obs is merged with the draws once, so a value that many rows share costs no more than
    another; rows then fetch theirs by an equi-join whose other side is written first, so that adaptive execution
    broadcasts it or splits a hot value.
    """
    table = draws if isinstance(draws, EcdfTable) else EcdfTable(draws, value)
    seen = obs.select(F.col("label"), known(F.col(column)).alias("ecdf_x")).distinct()
    found = materialised(table.percentile(seen, "ecdf_x", "percentile").withColumnRenamed("label", "ecdf_l"), "percentiles")
    both = obs.join(found, (F.col("label") == F.col("ecdf_l")) & (known(F.col(column)) == F.col("ecdf_x")))
    return both.select(*[F.col(c) for c in obs.columns], "percentile")


def label_percentiles(obs: DataFrame, draws: DataFrame | EcdfTable, labels: Iterable[str], column: str, value: str, out: str = "percentiles") -> DataFrame:
    """obs with the percentiles of `column` among each label's draws, as an array in the order of the labels; 0 for NaN and null.

    The same as percentiles() of every row with every label, but rows are joined once, and whole. A label without draws
    has null.
    """
    labels = list(labels)
    table = draws if isinstance(draws, EcdfTable) else EcdfTable(draws, value)
    seen = obs.select(known(F.col(column)).alias("ecdf_x")).distinct().select("ecdf_x", F.explode(F.array(*map(F.lit, labels))).alias("label"))
    found = table.percentile(seen, "ecdf_x", "p").groupBy("ecdf_x").agg(*[F.max(F.when(F.col("label") == x, F.col("p"))).alias(f"p{i}") for i, x in enumerate(labels)])
    found = materialised(found.select("ecdf_x", F.array(*[f"p{i}" for i in range(len(labels))]).alias("ecdf_p")), "percentiles")
    both = obs.join(found, known(F.col(column)) == F.col("ecdf_x"))
    return both.select(*[F.col(c) for c in obs.columns], F.col("ecdf_p").alias(out))


@dataclass(frozen=True, slots=True)
class ScenarioScore:
    time_percentile: float
    time_compatibility: float
    genetic_percentile: float
    genetic_compatibility: float
    compatibility: float

    def __getitem__(self, key: str) -> float:
        return self.to_dict()[key]

    def __iter__(self) -> Iterator[str]:
        return iter(self.to_dict())

    def __len__(self) -> int:
        return 5

    def __contains__(self, key: object) -> bool:
        return key in self.to_dict()

    def to_dict(self) -> dict[str, float]:
        return asdict(self)


@dataclass(frozen=True, slots=True)
class PairResult:
    target: str | tuple[str, ...]
    target_labels: tuple[str, ...]
    target_compatibility: float
    scenario_scores: dict[str, ScenarioScore]

    def __getitem__(self, key: str):
        return self.to_dict()[key]

    def __iter__(self) -> Iterator[str]:
        return iter(self.to_dict())

    def __len__(self) -> int:
        return 4

    def __contains__(self, key: object) -> bool:
        return key in self.to_dict()

    def to_dict(self) -> dict:
        target = list(self.target) if isinstance(self.target, tuple) else self.target
        return {"target": target, "target_labels": list(self.target_labels), "target_compatibility": self.target_compatibility, "scenario_scores": {k: v.to_dict() for k, v in self.scenario_scores.items()}}


def draw_counts(draws: DataFrame) -> DataFrame:
    """label, n."""
    return draws.groupBy("label").agg(F.count("*").alias("n"))


class PairScorer:
    """Scores of one set of target scenarios, by expressions and joins of the engine alone.

    Up to CONSTANT_DRAWS distinct draws are sorted constants of the plan, which each row bisects; more stay a table that
    observations are merged with. Both give the same results and errors. Columns, SQL functions and streams bisect
    constants whatever the number of draws.
    """

    def __init__(self, draws: DataFrame, labels: tuple[str, ...], constant_draws: int | None = None) -> None:
        self.labels = labels
        most = CONSTANT_DRAWS if constant_draws is None else constant_draws
        ends = F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), F.col(value).cast("double").alias("v")) for i, (_, _, value) in enumerate(AXES)]))
        picked = draws.where(F.col("label").isin(*labels)).select("label", ends.alias("e")).select("label", "e.axis", "e.v")
        self.counts = materialised(picked.groupBy("label", "axis", "v").agg(F.count("*").alias("c")), "ecdf-counts")
        sizes = {(r["label"], r["axis"]): r["n"] for r in self.counts.groupBy("label", "axis").agg(F.count("*").alias("n")).collect()}
        if missing := [x for x in labels if (x, 0) not in sizes]:
            raise SimulationError(f"no draws for {', '.join(missing)}")
        self.constant = sum(sizes.values()) <= most
        self._steps: dict[tuple[str, int], Steps] | None = None

    def table(self, axis: int) -> EcdfTable:
        """The table of one axis."""
        return EcdfTable.of(self.counts.where(F.col("axis") == axis).select("label", "v", "c"))

    def steps(self) -> dict[tuple[str, int], Steps]:
        """The distribution functions as sorted arrays, on the driver: 16 bytes a distinct draw."""
        if self._steps is None:
            held = self.counts.toArrow().to_pandas()
            self._steps = {}
            for (label, axis), rows in held.groupby(["label", "axis"]):
                order = np.argsort(rows["v"].to_numpy())
                self._steps[label, int(axis)] = Steps(rows["v"].to_numpy()[order], np.cumsum(rows["c"].to_numpy()[order]))
        return self._steps

    def _pairs(self) -> list[tuple[Steps, Steps]]:
        steps = self.steps()
        return [(steps[x, 0], steps[x, 1]) for x in self.labels]

    def score_column(self, time: Column, genetic: Column) -> Column:
        """The summed compatibility as a column; null and NaN score 0."""
        t, g = known(time), known(genetic)
        return _total([compatibility(x.share(t)) * compatibility(y.share(g)) for x, y in self._pairs()])

    def score_sql(self, time: str, genetic: str) -> str:
        """The same as SQL, of two SQL expressions."""
        known_sql = lambda x: f"coalesce(cast({x} as double), double('NaN'))"
        fit = lambda s, x: f"(1 - 2 * abs({s.share_sql(known_sql(x))} - 0.5D))"
        return " + ".join(f"{fit(x, time)} * {fit(y, genetic)}" for x, y in self._pairs())

    def shares(self, time: float, genetic: float) -> dict[str, tuple[float, float]]:
        """Each label's percentiles of two numbers: from the driver's arrays, or by one aggregation where draws are many."""
        if self.constant:
            steps = self.steps()
            return {x: (steps[x, 0].of(time), steps[x, 1].of(genetic)) for x in self.labels}
        asked = F.when(F.col("axis") == 0, F.lit(time)).otherwise(F.lit(genetic))
        below = F.sum(F.when((F.col("v") <= asked) & ~F.isnan(asked), F.col("c")).otherwise(0)) / F.sum("c")
        found = {(r["label"], r["axis"]): r["p"] for r in self.counts.groupBy("label", "axis").agg(below.alias("p")).collect()}
        return {x: (found[x, 0], found[x, 1]) for x in self.labels}

    def score_values(self, time: float, genetic: float) -> float:
        """The summed compatibility of two numbers."""
        return float(sum(compatibility_from_percentile(p) * compatibility_from_percentile(q) for p, q in self.shares(time, genetic).values()))

    def _percentiles(self, obs: DataFrame, time: str, genetic: str) -> DataFrame:
        """obs with scored_time and scored_genetic: percentiles in the order of the labels."""
        if self.constant or obs.isStreaming:
            columns = [F.array(*[F.when(F.isnan(x), 0.0).otherwise(pair[axis].share(x)) for pair in self._pairs()]) for axis, x in enumerate((known(F.col(time)), known(F.col(genetic))))]
            return obs.select("*", columns[0].alias("scored_time"), columns[1].alias("scored_genetic"))
        for axis, column, out in ((0, time, "scored_time"), (1, genetic, "scored_genetic")):
            obs = label_percentiles(obs, self.table(axis), self.labels, column, "v", out)
        return obs

    def breakdown(self, obs: DataFrame, time: str = TIME, genetic: str = GENETIC) -> DataFrame:
        """obs with label, both percentiles and compatibilities, and their product: a row for each scenario. NaN has percentile 0."""
        names = ["label", "time_percentile", "time_compatibility", "genetic_percentile", "genetic_compatibility", "compatibility"]
        if clash := {c.lower() for c in obs.columns} & set(names):
            raise ConfigurationError(f"columns {sorted(clash)} are those of the result")
        rows = F.explode(F.arrays_zip(F.array(*map(F.lit, self.labels)).alias("label"), F.col("scored_time").alias("time_percentile"), F.col("scored_genetic").alias("genetic_percentile")))
        both = self._percentiles(obs, time, genetic).select(*[F.col(c) for c in obs.columns], rows.alias("scored")).select(*[F.col(c) for c in obs.columns], "scored.*")
        both = both.withColumn("time_compatibility", compatibility(F.col("time_percentile"))).withColumn("genetic_compatibility", compatibility(F.col("genetic_percentile")))
        return both.withColumn("compatibility", F.col("time_compatibility") * F.col("genetic_compatibility")).select(*obs.columns, *names)

    def score(self, obs: DataFrame, time: str = TIME, genetic: str = GENETIC, out: str = "score") -> DataFrame:
        """obs, a table or a stream, with the sum of its compatibilities; null and NaN score 0."""
        if self.constant or obs.isStreaming:
            return obs.withColumn(out, self.score_column(F.col(time), F.col(genetic)))
        now = obs.drop(out) if out in obs.columns and out not in (time, genetic) else obs
        fits = F.zip_with("scored_time", "scored_genetic", lambda p, q: compatibility(p) * compatibility(q))
        return self._percentiles(now, time, genetic).select(*[F.col(c) for c in now.columns if c != out], F.aggregate(fits, F.lit(0.0), lambda acc, x: acc + x).alias(out))

    __call__ = score


def _total(columns: list[Column]) -> Column:
    return reduce(operator.add, columns)


def score_function(scorer: PairScorer):
    """The score as a function of two columns."""
    return scorer.score_column


class LinkageModel:
    """Draws of all scenarios, made once and kept, and scores of pairs against them."""

    def __init__(self, spark: SparkSession, profile: FromInfectiousness, maximum_depth: int = 2, mc_samples: int = 10_000, target="all-direct", mutation_process: str = "stochastic", seed: int | None = None, draws: DataFrame | None = None) -> None:
        for name, value, least in (("maximum_depth", maximum_depth, 0), ("mc_samples", mc_samples, 1)):
            if isinstance(value, bool) or not isinstance(value, int) or value < least:
                raise ConfigurationError(f"{name} must be a whole number of {least} or more")
        mutation_process = canonical_process(mutation_process)
        self.spark, self.profile = spark, profile
        self.scenarios = enumerate_scenarios(maximum_depth)
        self.labels = [s.label() for s in self.scenarios]
        self.target = ("ad(0)", "ca(0,0)") if isinstance(target, str) and target == "all-direct" else target
        self.target_labels = resolve_targets(self.target, self.labels)
        self.args = {"maximum_depth": maximum_depth, "mc_samples": mc_samples, "target": self.target, "mutation_process": mutation_process, "seed": seed}
        if draws is None:
            try:
                start = getattr(profile, "seed", None)
                start = int(np.random.SeedSequence().entropy % 2**63) if start is None else start
                draws = materialised(draw_frame(spark, profile, maximum_depth, mc_samples, mutation_process, start, start if seed is None else seed), "draws")
            except Exception as e:  # the worker's error names the scenario
                failed = re.search(r"the draws of scenario (ad|ca)\([0-9,]+\) failed: [^\n]*", str(e))
                raise SimulationError(failed[0] if failed else f"the draws failed: {e}") from e
        self.draws = draws
        self._scorers: dict[tuple[str, ...], PairScorer] = {}

    def with_draws(self, draws: DataFrame) -> LinkageModel:
        """The same model over other draws (label, time_draw, branch_draw, genetic_draw)."""
        return LinkageModel(self.spark, self.profile, draws=draws, **self.args)

    def scorer(self, target: str | Scenario | Iterable[str | Scenario] | None = None) -> PairScorer:
        """The scorer of a target; one for each set of scenarios."""
        labels = self.target_labels if target is None else resolve_targets(target, self.labels)
        if labels not in self._scorers:
            self._scorers[labels] = PairScorer(self.draws, labels)
        return self._scorers[labels]

    def score_target(self, obs, *args, **more):
        """The summed compatibility with a target: of a table or stream, as a column, or of two numbers, as a float.

        score_target(obs, target=None, time=..., genetic=..., out="score") or
        score_target(sample_time_difference, genetic_distance, target=None).
        """
        return self._score_table(obs, *args, **more) if isinstance(obs, DataFrame) else self._score_numbers(obs, *args, **more)

    def _score_table(self, obs: DataFrame, target=None, time: str = TIME, genetic: str = GENETIC, out: str = "score") -> DataFrame:
        return self.scorer(target).score(obs, time, genetic, out)

    def _score_numbers(self, sample_time_difference: float, genetic_distance: float, target=None) -> float:
        return self.scorer(target).score_values(*_numbers(sample_time_difference, genetic_distance))

    def score_pairs(self, obs: DataFrame, time: str = TIME, genetic: str = GENETIC) -> DataFrame:
        """A row for each observation and scenario."""
        return self.scorer(self.labels).breakdown(obs, time, genetic)

    def score_pair(self, sample_time_difference: float, genetic_distance: float) -> PairResult:
        """All scores of one pair."""
        t, g = _numbers(sample_time_difference, genetic_distance)
        scores = {}
        for label, (p, q) in self.scorer(tuple(self.labels)).shares(t, g).items():
            fits = compatibility_from_percentile(p), compatibility_from_percentile(q)
            scores[label] = ScenarioScore(p, fits[0], q, fits[1], fits[0] * fits[1])
        target = self.target if isinstance(self.target, str) else tuple(Scenario.parse(t).label() for t in ([self.target] if isinstance(self.target, Scenario) else self.target))
        return PairResult(target, self.target_labels, sum(scores[x].compatibility for x in self.target_labels), scores)

    def score_grid(self, times: list[float], distances: list[float], target=None) -> DataFrame:
        """Every time with every distance."""
        t = self.spark.createDataFrame([(float(x),) for x in times], f"{TIME} double")
        g = self.spark.createDataFrame([(float(x),) for x in distances], f"{GENETIC} double")
        return self.score_target(t.crossJoin(g), target)


def _numbers(*values) -> list[float]:
    for name, value in zip((TIME, GENETIC), values):
        if value is None or np.ndim(value) != 0 or isinstance(value, (str, bool)):
            raise TypeError(f"{name} must be one number")
    return [float(x) for x in values]


def percentile_score(observed: float, simulated) -> float:
    return float(np.mean(np.asarray(simulated) <= observed))


def compatibility_from_percentile(p: float) -> float:
    return 1 - 2 * abs(p - 0.5)


def compatibility_score(observed: float, simulated) -> tuple[float, float]:
    p = percentile_score(observed, simulated)
    return p, compatibility_from_percentile(p)


__all__ = ["LinkageModel", "PairScorer", "PairResult", "ScenarioScore", "ScenarioError", "EcdfTable", "ecdf", "percentile_score", "compatibility_from_percentile", "compatibility_score", "label_percentiles", "percentiles"]
