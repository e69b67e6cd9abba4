"""The registered queries of this subpackage, by name, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.ann import op2_adaptive_scan
from tessera.llm.bpe import op6_byte_pairs
from tessera.llm.hilbert import op7_hilbert_sharding
from tessera.llm.jaccard_join import op9_ngram_jaccard_join
from tessera.llm.katz import op5_katz_backoff
from tessera.llm.packing import op10_packing
from tessera.llm.quality import op1_quality_classifier
from tessera.llm.sql import LINKED_COMPONENTS, TOP_PRODUCTS, sharding_sql
from tessera.llm.token_files import op4_token_files
from tessera.llm.topk import op8_exact_top_k
from tessera.llm.toxicity import op3_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_adaptive_scan": op2_adaptive_scan,
    "op3_toxicity": op3_toxicity,
    "op4_token_files": op4_token_files,
    "op5_katz_backoff": op5_katz_backoff,
    "op6_byte_pairs": op6_byte_pairs,
    "op7_hilbert_sharding": op7_hilbert_sharding,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_packing": op10_packing,
}

#: The other queries are learnt, approximate, or need tokenizers or digests that DuckDB lacks; tests hold them against plain forms.
ORACLE_SQL: dict[str, str] = {
    "op7_hilbert_sharding": sharding_sql(),
    "op8_exact_top_k": TOP_PRODUCTS,
    "op9_ngram_jaccard_join": LINKED_COMPONENTS,
}
