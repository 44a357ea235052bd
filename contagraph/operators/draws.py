"""Monte Carlo draws of each scenario, keyed by block, so that they don't depend on partitioning."""

from __future__ import annotations

import inspect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contagraph.exceptions import ConfigurationError, SimulationError
from contagraph.functions.profiles import FromInfectiousness
from contagraph.operators.scenarios import Scenario, enumerate_scenarios, scenario_frame

BLOCK = 1000
DRAWS = "ord int, label string, draw_id long, time_draw double, branch_draw double, genetic_draw double"


def mutation_process(name: str) -> str:
    """The name in canonical form."""
    clean = name.strip().lower() if isinstance(name, str) else name
    if clean not in ("deterministic", "stochastic"):
        raise ConfigurationError("mutation_process must be deterministic or stochastic")
    return clean


def scenario_draws(profile, scenario: Scenario, n: int, rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Time between the two samplings (j's minus i's) and days along the branch between them, n times.

    Direct: j is infected a path of generations after i, so the branch is the time, cut at 0. Shared source: both paths
    start together; the branch is the sum of both paths, incubations and delays.
    """
    extra = {} if rng is None else {"rng": rng}
    inc_i, inc_j = profile.sample_incubation_periods(n, **extra), profile.sample_incubation_periods(n, **extra)
    delay_i, delay_j = profile.sample_testing_delays(n, **extra), profile.sample_testing_delays(n, **extra)
    path = lambda k: profile.sample_generation_intervals((k + 1, n), **extra).sum(0)
    if scenario.kind == "ad":
        time = path(scenario.intermediates) + inc_j + delay_j - inc_i - delay_i
        return time, np.maximum(time, 0)
    to_i, to_j = path(scenario.branch_to_i), path(scenario.branch_to_j)
    return to_j - to_i + inc_j + delay_j - inc_i - delay_i, to_i + to_j + inc_i + inc_j + delay_i + delay_j


def genetic_draws(profile, branch: np.ndarray, process: str, rng: np.random.Generator | None = None, counts: np.random.Generator | None = None) -> np.ndarray:
    """Mutations along the branch, with a clock rate for each draw: expected, by the profile's own rule if it has one, or Poisson."""
    process = mutation_process(process)
    extra = {} if rng is None else {"rng": rng}
    own = getattr(profile, "expected_mutations", None)
    expected = np.asarray(own(branch, **extra) if own else branch * profile.sample_clock_rate(len(branch), **extra), float)
    return expected if process == "deterministic" else (counts or rng or np.random.default_rng()).poisson(expected)


def _takes_rng(profile) -> bool:
    """Whether all samplers can be given a generator."""
    samplers = (profile.sample_incubation_periods, profile.sample_testing_delays, profile.sample_generation_intervals, getattr(profile, "expected_mutations", None) or profile.sample_clock_rate)
    return all("rng" in (p := inspect.signature(f).parameters) or any(x.kind is x.VAR_KEYWORD for x in p.values()) for f in samplers)


def draw_frame(spark: SparkSession, profile: FromInfectiousness, depth: int, n: int, process: str = "stochastic", seed: int = 0, mutation_seed: int | None = None) -> DataFrame:
    """n draws of every scenario up to `depth`: rows of (scenario, block) are seeded by both, then drawn with NumPy.

    A profile is any object with the samplers of TransmissionProfile. Where they take no `rng`, they have a state of their
    own that can't be dealt out: such a profile is asked on the driver, n at a time, in the order of the scenarios.
    """
    process = mutation_process(process)
    mutation_seed = seed if mutation_seed is None else mutation_seed
    if hasattr(profile, "grid"):
        profile.grid()

    def drawn(order: int, label: str, block: int, size: int, rng: np.random.Generator | None) -> pd.DataFrame:
        counts = np.random.default_rng([mutation_seed, order, block, 1])
        try:
            time, branch = scenario_draws(profile, Scenario.parse(label), size, rng)
            genetic = np.asarray(genetic_draws(profile, branch, process, rng, counts), float)
        except Exception as e:
            raise SimulationError(f"the draws of scenario {label} failed: {e}") from e
        return pd.DataFrame({"ord": order, "label": label, "draw_id": block * BLOCK + np.arange(size), "time_draw": time, "branch_draw": branch, "genetic_draw": genetic})

    if not _takes_rng(profile):
        every = pd.concat([drawn(i, s.label(), 0, n, None) for i, s in enumerate(enumerate_scenarios(depth))])
        return spark.createDataFrame(every, DRAWS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                yield drawn(r.ord, r.label, r.block, min(BLOCK, n - r.block * BLOCK), np.random.default_rng([seed, r.ord, r.block]))

    blocks = spark.range(-(-n // BLOCK)).select(F.col("id").alias("block"))
    keys = scenario_frame(spark, depth).crossJoin(blocks)
    return keys.repartition("ord", "block").select("ord", "label", "block").mapInPandas(run, DRAWS)
