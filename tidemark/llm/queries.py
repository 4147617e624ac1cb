"""The queries and the SQL of this subpackage, by name."""

from __future__ import annotations

from tidemark.llm.chat import op8_chat_format
from tidemark.llm.fingerprint import op1_fingerprints
from tidemark.llm.lexical import op12_ranked_search
from tidemark.llm.merkle import op11_merkle_manifest
from tidemark.llm.mixing import mixing_targets, op7_mixing
from tidemark.llm.ngram_join import op3_ngram_jaccard
from tidemark.llm.oracles import ORACLE_SQL
from tidemark.llm.pieces import op5_sentencepiece
from tidemark.llm.quality import op10_quality_rules, quality_ablation
from tidemark.llm.sharding import op9_sharding, shard_totals
from tidemark.llm.substring import op4_substring_dedup
from tidemark.llm.tokens import op6_token_counts
from tidemark.llm.toxicity import op13_toxicity
from tidemark.llm.urls import op2_url_filters

QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_url_filters, op3_ngram_jaccard, op4_substring_dedup, op5_sentencepiece, op6_token_counts, op7_mixing, op8_chat_format, op9_sharding, op10_quality_rules, op11_merkle_manifest, op12_ranked_search, op13_toxicity, quality_ablation, mixing_targets, shard_totals)}

__all__ = ["ORACLE_SQL", "QUERIES"]
