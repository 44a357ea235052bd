"""Observations from and to CSV."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from typing import TextIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contagraph.exceptions import ConfigurationError
from contagraph.operators.scorer import GENETIC, TIME
from contagraph.plans.shared import copy_parts, discard, materialised, scratch

# What pandas takes for a missing number, in lower case.
_MISSING = ("", "#n/a", "#n/a n/a", "#na", "-1.#ind", "-1.#qnan", "-nan", "1.#ind", "1.#qnan", "<na>", "n/a", "na", "nan", "none", "null")
ROW = "csv_row"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files, as file, block, record (both numbers in order) and text; quoted fields may hold line feeds.

    A file is read in splits. A line is within a quoted field if the quotes before it are odd in number, so each split
    counts its own, the sums of all splits before it are carried on, and lines are put together to records from there.
    A record that spans splits belongs to that where it begins. Blank lines between records go. ConfigurationError where a
    quoted field has no end.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    quotes = (F.length("value") - F.length(F.replace("value", F.lit('"')))).alias("quotes")
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"), quotes)
    # a row for each split
    along = Window.partitionBy("file").orderBy("block")
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("n"))
    blocks = blocks.select("file", "block", F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("file")).alias("all"))
    blocks = materialised(blocks, "csv-blocks")
    if not blocks.where(F.col("all") % 2 == 1).isEmpty():
        raise ConfigurationError("a quoted field has no end")
    inside = Window.partitionBy("file", "block").orderBy("line")
    before = F.col("before") + F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(blocks.drop("all"), ["file", "block"]).withColumn("starts", before % 2 == 0)
    placed = placed.withColumn("record", F.sum(F.col("starts").cast("long")).over(inside)).withColumn("whole", F.col("starts") & (F.col("quotes") % 2 == 0))
    placed = materialised(placed.select("file", "block", "line", "record", "whole", "text"), "csv-placed")
    single = placed.where("whole").select("file", "block", "record", "text")
    # lines before a split's first record go on with the last one of a split before
    last = placed.groupBy("file", "block").agg(F.max("record").alias("records"))
    owner = F.last(F.when(F.col("records") > 0, F.struct(F.col("block").alias("block"), F.col("records").alias("record"))), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    owners = last.select("file", "block", owner.alias("owner"))
    parts = placed.where(~F.col("whole")).join(owners, ["file", "block"])
    at = F.when(F.col("record") > 0, F.struct("block", "record")).otherwise(F.col("owner"))
    joined = parts.select("file", at.alias("at"), F.struct("block", "line", "text").alias("part")).groupBy("file", "at").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    spanning = joined.select("file", "at.block", "at.record", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    found = single.unionByName(spanning).withColumn("text", F.regexp_replace("text", "\r\\z", ""))
    out = materialised(found.where(F.trim("text") != ""), "csv-records")
    discard(blocks, placed)
    return out


def _names(header: str) -> list[str]:
    """The header's names; one that was there before gets .1, .2, ..."""
    out: list[str] = []
    for name in next(csv.reader(io.StringIO(header))):
        new, n = name, 0
        while new in out:
            n += 1
            new = f"{name}.{n}"
        out.append(new)
    return out


def _number(text: Column) -> Column:
    bare = F.trim(text)
    return F.when(text.isNull() | F.lower(bare).isin(*_MISSING), F.lit(float("nan"))).otherwise(bare.cast("double"))


def read_observations(spark: SparkSession, path: str, keep_order: bool = False) -> DataFrame:
    """CSV files with a header: the two required columns as doubles (missing marks as NaN, else an error), the rest as text.

    Quoted fields may hold commas, line feeds and doubled quotes; files are read in splits all the same. Of repeated names
    the later ones get .1, .2, ... With keep_order a column csv_row follows, by which rows are in the order of the input.
    """
    records = read_records(spark, path)
    first = records.orderBy("file", "block", "record").first()
    names = _names(first["text"]) if first else []
    if missing := [c for c in (TIME, GENETIC) if c not in names]:
        raise ConfigurationError(f"the input lacks the columns {', '.join(missing)}")
    # each file's first record is its header
    heads = records.groupBy("file").agg(F.min(F.struct("block", "record")).alias("head"))
    body = records.join(heads, "file").where(F.struct("block", "record") != F.col("head"))
    fields = F.from_csv("text", ", ".join(f"c{i} string" for i in range(len(names))), {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    rows = body.select("file", "block", "record", fields.alias("f"))
    values = [F.col(f"f.c{i}") for i in range(len(names))]
    out = [(_number(v) if c in (TIME, GENETIC) else v).alias(c) for c, v in zip(names, values)]
    return rows.select(*out, *([F.struct("file", "block", "record").alias(ROW)] if keep_order else []))


def _formatted(df: DataFrame) -> tuple[str, DataFrame]:
    """The header, and a table of one column, a line for each row, in order: formatted where the rows are."""
    columns = [c for c in df.columns if c != ROW]
    ordered = df.repartitionByRange(ROW).sortWithinPartitions(ROW) if ROW in df.columns else df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))
            yield pa.RecordBatch.from_arrays([pa.array(["\n" if not columns else _line(r) for r in rows], pa.string())], names=["value"])

    return _line(columns), ordered.select(*[F.col("`" + c.replace("`", "``") + "`") for c in columns]).mapInArrow(run, "value string")


def _line(values) -> str:
    text = io.StringIO()
    csv.writer(text, lineterminator="").writerow(["" if v is None or v != v else v for v in values])
    return text.getvalue()


def write_csv(df: DataFrame, out: str | TextIO) -> None:
    """One file, of the driver's machine or of a URI, or a stream, with header, in input order.

    Tasks write their parts of the order to the shared folder; the file is these, one after the other. A stream gets the
    formatted lines, a partition at a time.
    """
    header, lines = _formatted(df)
    if not isinstance(out, str):
        out.write(header + "\n")
        for r in lines.toLocalIterator(prefetchPartitions=True):
            out.write(r["value"] + "\n")
        return
    parts = scratch(df.sparkSession, "csv-parts")
    lines.write.option("lineSep", "\n").text(parts)
    copy_parts(df.sparkSession, parts, out, header + "\n")


def write_csv_folder(df: DataFrame, path: str) -> None:
    """A folder of files with headers, written by all tasks; read_observations() reads it back."""
    df.drop(ROW).write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
