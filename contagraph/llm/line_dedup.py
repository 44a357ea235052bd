"""Line deduplication: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contagraph.llm.common import BLANKS, ascii_lower, col, fresh, table

MIN_CHARS, MIN_DOCS = 20, 3
_NO_ID = -(2**63)


def line_key(line: Column) -> Column:
    return F.trim(ascii_lower(line), F.lit(BLANKS))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with `text` rebuilt, plus n_lines and n_dropped.

    A line's key is the line stripped of blanks with A-Z lower-cased. Keys of at least min_chars code points that
    occur in min_docs or more distinct documents are dropped from all of them but the one with the largest id.

    Null text counts as one empty line and comes back as "". A null id counts as one document, smaller than all others.
    Rows that share an id are one document. Existing n_lines or n_dropped columns are kept; ours then get an underscore.

    Lines and texts may be of any length: a text's work grows with its lines, times the root of those it loses.

    A row's keys leave it as a pair of 64-bit hashes, so text crosses the network once, in the last join. Keys are first
    made distinct with their document, which spreads a line that every document has; the count that follows combines
    before its shuffle. The frequent keys are shuffled once more for their join, so that adaptive execution can split a
    line that every text holds; a document's lost keys meet its rows in one task. Inside a document its lost
    lines are found again by the first hash. An empty table gives an empty one.
    """
    n_lines, n_dropped, did, gone, whole, kept_lines = fresh(docs, "n_lines", "n_dropped", "did", "gone", "whole", "kept_lines")
    did_of = F.coalesce(col(doc_id).cast("long"), F.lit(_NO_ID))
    body = F.coalesce(col(text), F.lit(""))
    long_lines = F.filter(F.split(body, "\n", -1), lambda x: F.char_length(x) >= min_chars)
    keys = F.filter(F.transform(long_lines, line_key), lambda k: F.char_length(k) >= min_chars)
    occurs = (
        docs.select(did_of.alias("did"), F.explode(F.transform(keys, lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2")))).alias("k"))
        .select("did", "k.h1", "k.h2")
        .groupBy("h1", "h2", "did").agg(F.lit(1).alias("one"))
    )
    frequent = occurs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("did").alias("last")).where(F.col("n") >= min_docs)
    # one more key than the sums were dealt out by: the join shuffles them anew, and only such a side lets hot keys be split
    both = F.xxhash64("h1", "h2").alias("h")
    frequent = frequent.select("h1", "h2", both, "last")
    # a document's lost hashes in bins, so that a text which loses thousands of lines isn't compared with all of them each time
    bins = F.ceil(F.sqrt(F.size(gone) / 8)).cast("long")
    drops = (
        occurs.select("h1", "h2", both, "did").join(frequent, ["h1", "h2", "h"]).where(F.col("did") < F.col("last"))
        .groupBy(F.col("did").alias(did)).agg(F.collect_list("h1").alias(gone))
        .withColumn(gone, F.transform(F.sequence(F.lit(0).cast("long"), bins - 1), lambda b: F.filter(gone, lambda g: F.pmod(g, bins) == b)))
    )
    lines = F.split(F.col(whole), "\n", -1)
    lost = lambda h: F.array_contains(F.get(gone, F.pmod(h, F.size(gone).cast("long")).cast("int")), h)
    kept = F.filter(lines, lambda x: ~((F.char_length(x) >= min_chars) & lost(F.xxhash64(line_key(x)))))
    joined = docs.withColumn(did, did_of).withColumn(whole, body).join(drops, did, "left")
    parts = joined.withColumn(kept_lines, F.when(F.col(gone).isNull(), lines).otherwise(kept))
    return parts.select(
        *[(F.array_join(kept_lines, "\n").alias(c) if c == text else col(c)) for c in docs.columns],
        F.size(lines).cast("long").alias(n_lines),
        (F.size(lines) - F.size(kept_lines)).cast("long").alias(n_dropped),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, lower_ascii AS key FROM (
    SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
    FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))
), heavy AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), kept AS (
  SELECT l.*, h.key IS NOT NULL AND l.doc_id <> h.last AS gone FROM lines l LEFT JOIN heavy h ON l.key = h.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""
