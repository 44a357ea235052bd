"""Shared helpers: input tables, text functions, and collision-free column names; tables in the shared folder are the library's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contagraph.plans.shared import discard, scratch
from contagraph.plans.shared import materialised as stash

__all__ = ["BLANKS", "BLANK_RUN", "ascii_lower", "col", "discard", "fold", "fresh", "in_order", "scratch", "short_batches", "spread", "stash", "table", "word_count"]

#: The characters that separate words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew if its scan has fewer splits than the session has cores, so that all of them work on a small table."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def short_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, whose session hands texts to Python workers in batches of at most `rows` from now on.

    Spark's default of 10,000 makes buffers of tens of MB in each task, on both sides, where texts are long. It is a
    setting of the session: a smaller one stays as it is. No result depends on it.
    """
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each with underscores added until no column of df has it in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def in_order(df: DataFrame, *but: str) -> Column | None:
    """The columns of df other than `but` as text, to order rows by; None without any. Rows of equal ones differ in no column."""
    others = [c for c in df.columns if c not in but]
    return F.struct(*[col(c).cast("string") for c in others]) if others else None


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Runs of characters other than BLANKS; null has none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, BLANK_RUN))).cast("long")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5 (null ids count as the text "")."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))
