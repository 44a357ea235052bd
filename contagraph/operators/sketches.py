"""Approximate distribution functions: mergeable quantile sketches (KLL) of the draws of each label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contagraph.functions.columns import bisected, known

#: Size parameter of a sketch; the ranks that are asked of it, evenly spaced. A percentile is off by less than BOUND with a
#: probability far above 99%: some 0.001 by the sketch, and 1 / RANKS.
SIZE, RANKS, BOUND = 3_200, 1_000, 0.005


def sketches(draws: DataFrame, value: str, label: str = "label", size: int = SIZE) -> DataFrame:
    """label, sketch, n: of a label's draws that are numbers; partial sketches merge before they are shuffled.

    A sketch has some KB however many draws there are, so it can be kept, and merged with those of draws made later.
    """
    x = F.col(value).cast("double")
    return draws.where(x.isNotNull() & ~F.isnan(x)).groupBy(F.col(label).alias("label")).agg(F.kll_sketch_agg_double(x, F.lit(size)).alias("sketch"), F.count("*").alias("n"))


def merged(*parts: DataFrame) -> DataFrame:
    """The sketches of all parts' draws, from those of each."""
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.groupBy("label").agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def approximate_percentiles(obs: DataFrame, kept: DataFrame, column: str, out: str = "percentile") -> DataFrame:
    """obs (with `label`) and about the share of the label's draws that are no larger; 0 for NaN and null.

    One pass without a sort or shuffle of obs where the sketches, a row for each label, are small enough to be sent to all
    tasks. Rows of a label without a sketch go.
    """
    x = known(F.col(column))
    # the functions of a sketch take constants only, so the row bisects its quantiles
    held = kept.select(F.col("label").alias("sketch_label"), F.expr(f"kll_sketch_get_quantile_double(sketch, array({', '.join(f'{i / RANKS!r}D' for i in range(RANKS + 1))}))").alias("sketch_of"))
    both = obs.join(held, F.col("label") == F.col("sketch_label"))
    below = bisected(F.col("sketch_of"), RANKS + 1, x) - 1
    return both.select(*[F.col(c) for c in obs.columns], F.when(F.isnan(x), 0.0).otherwise(F.greatest(F.lit(0), below) / float(RANKS)).alias(out))
