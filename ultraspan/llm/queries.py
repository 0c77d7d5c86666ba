"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op11_bpe
from .centroids import OP12_SQL, op12_centroids
from .conversations import OP13_SQL, op13_conversation_repair
from .decontaminate import op5_decontaminate
from .language import op2_language_id
from .licenses import op1_license_scan
from .mixing import OP6_SQL, op6_mix_sources
from .ngram_join import op10_ngram_join
from .pii import op8_pii
from .suffix_dedup import op9_suffix_dedup
from .topk import OP3_SQL, op3_topk_search
from .toxicity import op4_toxicity
from .url_filter import OP7_SQL, op7_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_language_id": op2_language_id,
        "op3_topk_search": op3_topk_search,
        "op4_toxicity": op4_toxicity,
        "op5_decontaminate": op5_decontaminate,
        "op6_mix_sources": op6_mix_sources,
        "op7_url_filter": op7_url_filter,
        "op8_pii": op8_pii,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_ngram_join": op10_ngram_join,
        "op11_bpe": op11_bpe,
        "op12_centroids": op12_centroids,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_topk_search": OP3_SQL,
        "op6_mix_sources": OP6_SQL,
        "op7_url_filter": OP7_SQL,
        "op12_centroids": OP12_SQL,
        "op13_conversation_repair": OP13_SQL,
    }
