"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from tidemark.llm.bpe_codec import op7_byte_bpe
from tidemark.llm.chat import OP4_SQL, op4_event_chat
from tidemark.llm.divergence import OP12_SQL, op12_source_divergence
from tidemark.llm.hard_negatives import OP11_SQL, op11_summa_negatives
from tidemark.llm.id_files import op10_arrow_ids
from tidemark.llm.language import op13_byte_network
from tidemark.llm.packing import op8_best_fit
from tidemark.llm.quality import op2_robust_quality
from tidemark.llm.simhash import op6_simhash
from tidemark.llm.suffix_tree import op1_suffix_tree
from tidemark.llm.urls import op9_url_filter
from tidemark.llm.topk import OP3_SQL, op3_norm_buckets
from tidemark.llm.toxicity import op5_toxicity

QUERIES = [op1_suffix_tree, op2_robust_quality, op3_norm_buckets, op4_event_chat, op5_toxicity, op6_simhash, op7_byte_bpe, op8_best_fit, op9_url_filter, op10_arrow_ids, op11_summa_negatives, op12_source_divergence, op13_byte_network]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_norm_buckets": OP3_SQL, "op4_event_chat": OP4_SQL, "op11_summa_negatives": OP11_SQL, "op12_source_divergence": OP12_SQL}
