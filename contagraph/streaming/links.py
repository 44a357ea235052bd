"""The best link of each case in windows of time, kept as state while links come in as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_links(links: DataFrame, window: str = "7 days", delay: str = "1 hour") -> DataFrame:
    """start, case_id, linked, score, seen: of the links (case_id, linked, score, at) of a case that fall into a window of
    event time the one with the highest score, of equals that with the smallest id, and how many there are.

    On a stream this is state: a row for each window and case. In update mode a case is told whenever one of its links
    comes; in append mode once, when its window has ended. Once the latest time seen is `delay` past the end of a window,
    its state goes, and links that still come for it are late and dropped. Null scores are below all others; rows
    without a time or a case are passed over.
    """
    known = links.where(F.col("at").isNotNull() & F.col("case_id").isNotNull()).withWatermark("at", delay)
    first = F.struct(F.col("score"), -F.col("linked"))
    best = F.max_by(F.struct("linked", "score"), first)
    return known.groupBy(F.window("at", window).alias("span"), "case_id").agg(best.alias("best"), F.count("*").alias("seen")).select(F.col("span.start").alias("start"), "case_id", "best.linked", "best.score", "seen")
