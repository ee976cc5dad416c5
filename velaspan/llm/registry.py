"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from velaspan.llm.bpe import op1_bpe_roundtrip
from velaspan.llm.kneserney import op7_kneser_ney_quality
from velaspan.llm.langid import op10_language_mixture
from velaspan.llm.neardup import op2_minhash_dedup
from velaspan.llm.neighbours import op8_hnsw_neighbours
from velaspan.llm.oracles import OP2_SQL, OP3_SQL, OP9_SQL
from velaspan.llm.packing import op4_vector_packing
from velaspan.llm.repetition import op9_repetition_rules
from velaspan.llm.secrets import op6_secret_scan
from velaspan.llm.substrings import op3_substring_dedup
from velaspan.llm.warc import ORACLE as OP5_SQL
from velaspan.llm.warc import op5_arc_to_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe_roundtrip,
        op2_minhash_dedup,
        op3_substring_dedup,
        op4_vector_packing,
        op5_arc_to_warc,
        op6_secret_scan,
        op7_kneser_ney_quality,
        op8_hnsw_neighbours,
        op9_repetition_rules,
        op10_language_mixture,
    )
}

ORACLE_SQL: dict[str, str] = {"op2_minhash_dedup": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op5_arc_to_warc": OP5_SQL, "op9_repetition_rules": OP9_SQL}
