"""Scores of a stream of observations. Scoring is a function of the row alone, so no state or watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contagraph.operators.scorer import GENETIC, TIME, LinkageModel, PairScorer


def score_stream(stream: DataFrame, model: LinkageModel, target=None, time: str = TIME, genetic: str = GENETIC, out: str = "score") -> DataFrame:
    """The stream with its scores; the draws' distinct values are constants of its plan."""
    return model.scorer(target).score(stream, time, genetic, out)


def register_function(spark: SparkSession, scorer: PairScorer, name: str) -> None:
    """A scorer as an SQL function of (time difference, distance), which the engine evaluates itself."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t DOUBLE, g DOUBLE) RETURNS DOUBLE RETURN {scorer.score_sql('t', 'g')}")


def register_score(model: LinkageModel, name: str = "linkage_score", target=None) -> None:
    """The score of a model's target as an SQL function."""
    register_function(model.spark, model.scorer(target), name)
