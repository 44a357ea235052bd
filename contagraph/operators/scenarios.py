"""Transmission scenarios: labels, enumeration, targets."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contagraph.exceptions import ConfigurationError, ScenarioError

_LABEL = re.compile(r"ad\(([0-9]+)\)|ca\(([0-9]+),([0-9]+)\)")


@dataclass(frozen=True, slots=True)
class Scenario:
    """ad(m): one case infected the other through m unseen cases. ca(i,j): an unseen case infected both through i and j."""

    kind: str
    intermediates: int | None = None
    branch_to_i: int | None = None
    branch_to_j: int | None = None

    def __post_init__(self) -> None:
        if isinstance(self.kind, str):
            object.__setattr__(self, "kind", self.kind.strip().lower())
        counts = {"ad": (self.intermediates,), "ca": (self.branch_to_i, self.branch_to_j)}.get(self.kind)
        others = (self.branch_to_i, self.branch_to_j) if self.kind == "ad" else (self.intermediates,)
        if counts is None or any(isinstance(c, bool) or not isinstance(c, int) or c < 0 for c in counts) or any(c is not None for c in others):
            raise ScenarioError(f"no such scenario: {self.kind} {self.intermediates} {self.branch_to_i} {self.branch_to_j}")

    @classmethod
    def ancestor_descendant(cls, intermediates: int) -> Scenario:
        return cls("ad", intermediates)

    @classmethod
    def common_ancestor(cls, branch_to_i: int, branch_to_j: int) -> Scenario:
        return cls("ca", None, branch_to_i, branch_to_j)

    @classmethod
    def parse(cls, value: str | Scenario) -> Scenario:
        if isinstance(value, Scenario):
            return value
        found = _LABEL.fullmatch(value.strip().lower()) if isinstance(value, str) else None
        if not found:
            raise ScenarioError(f"not a scenario label: {value!r}")
        m, i, j = found.groups()
        return cls.ancestor_descendant(int(m)) if m is not None else cls.common_ancestor(int(i), int(j))

    def label(self) -> str:
        return f"ad({self.intermediates})" if self.kind == "ad" else f"ca({self.branch_to_i},{self.branch_to_j})"

    __str__ = label


def enumerate_scenarios(depth: int) -> list[Scenario]:
    """All scenarios with at most `depth` unseen intermediates, in canonical order."""
    if isinstance(depth, bool) or not isinstance(depth, int) or depth < 0:
        raise ScenarioError("the depth must be a whole number of 0 or more")
    direct = [Scenario.ancestor_descendant(m) for m in range(depth + 1)]
    return direct + [Scenario.common_ancestor(i, j) for i in range(depth + 1) for j in range(depth + 1 - i)]


def scenario_frame(spark: SparkSession, depth: int) -> DataFrame:
    """ord, label, kind, intermediates, branch_to_i, branch_to_j, from generated ranges."""
    nothing = F.lit(None).cast("int")
    r = lambda name: spark.range(depth + 1).select(F.col("id").cast("int").alias(name))
    direct = r("intermediates").select(F.lit("ad").alias("kind"), "intermediates", nothing.alias("branch_to_i"), nothing.alias("branch_to_j"), F.col("intermediates").alias("ord"), F.format_string("ad(%d)", "intermediates").alias("label"))
    i, j = F.col("branch_to_i"), F.col("branch_to_j")
    # before row i of the triangle come i * (depth + 1) - i * (i - 1) / 2 pairs
    place = F.lit(depth + 1) + i * (depth + 1) - (i * (i - 1) / 2).cast("int") + j
    shared = r("branch_to_i").crossJoin(r("branch_to_j")).where(i + j <= depth).select(F.lit("ca").alias("kind"), nothing.alias("intermediates"), "branch_to_i", "branch_to_j", place.cast("int").alias("ord"), F.format_string("ca(%d,%d)", "branch_to_i", "branch_to_j").alias("label"))
    return direct.unionByName(shared).select("ord", "label", "kind", "intermediates", "branch_to_i", "branch_to_j")


def resolve_targets(target: str | Scenario | Iterable[str | Scenario], available: list[str]) -> tuple[str, ...]:
    """Labels of the target, each once, in the order of `available`."""
    values = [target] if isinstance(target, (str, Scenario)) else list(target)
    wanted = {Scenario.parse(v).label() for v in values}
    if not wanted:
        raise ConfigurationError("a target needs a scenario")
    if missing := wanted.difference(available):
        raise ScenarioError(f"not among the scenarios: {', '.join(sorted(missing))}")
    return tuple(label for label in available if label in wanted)
