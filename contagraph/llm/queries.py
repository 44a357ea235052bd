"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from contagraph.llm.chroma import op3_chroma
from contagraph.llm.class_lm import op1_class_lm
from contagraph.llm.collision_ann import op7_collision_ann
from contagraph.llm.conversations import OP11_SQL, op11_conversation_repair
from contagraph.llm.divergence import OP12_SQL, op12_source_divergence
from contagraph.llm.jaccard_join import op4_jaccard_join
from contagraph.llm.language_id import op9_language_id
from contagraph.llm.line_dedup import OP10_SQL, op10_line_dedup
from contagraph.llm.mixing import op5_mix_sources
from contagraph.llm.secrets import op2_secret_scan
from contagraph.llm.sentencepiece_bpe import op8_sentencepiece
from contagraph.llm.suffix_dedup import op13_suffix_dedup
from contagraph.llm.warc import OP6_SQL, op6_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_class_lm, op2_secret_scan, op3_chroma, op4_jaccard_join, op5_mix_sources, op6_warc, op7_collision_ann, op8_sentencepiece, op9_language_id, op10_line_dedup, op11_conversation_repair, op12_source_divergence, op13_suffix_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": OP6_SQL, "op10_line_dedup": OP10_SQL, "op11_conversation_repair": OP11_SQL, "op12_source_divergence": OP12_SQL}
