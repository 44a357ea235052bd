"""The corpus pipeline: language ID, line dedup, near-duplicate removal, mixing, encoding.

Null texts and texts without a letter go in the first stage, which has no language for them; later stages would take them
as empty. Null ids, languages and sources stay as they are: null ids are one document to the line stage, rows of their own
to the join, and one source of their own holds the rows without one. Texts of any length are read whole. Repeated rows are
copies: the join keeps one of them. Of ties the smallest id stays, null last. Empty tables give empty tables. Extra
columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contagraph.llm.common import stash, table
from contagraph.llm.jaccard_join import keep_one
from contagraph.llm.language_id import UNKNOWN, identify, train, training_rows
from contagraph.llm.line_dedup import line_dedup
from contagraph.llm.mixing import mix
from contagraph.llm.sentencepiece_bpe import encode_decode


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is found, however short; the model learns from the stage's own rows."""
    names = docs.columns
    found = identify(docs, train(training_rows(docs)))
    return found.where(F.col(found.columns[-2]) != UNKNOWN).select(*names)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that other documents hold too; n_chars follows."""
    out = line_dedup(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents but the text, with its ids and digests; a row for each row."""
    coded = encode_decode(docs)
    n_tokens, ids, decoded = coded.columns[-3:]
    kept = [c for c in docs.columns if c != "text"]
    return coded.select(*kept, n_tokens, ids, F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language ID", language_stage), ("line dedup", line_stage), ("n-gram Jaccard join", join_stage), ("mixing sources", mix_stage), ("SentencePiece", encode_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stash(docs, f"pipeline-{i}") if i < len(STAGES) - 1 else docs
    return docs
