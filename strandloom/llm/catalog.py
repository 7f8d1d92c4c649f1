"""Queries and oracles of the training-data operators."""

from __future__ import annotations

from strandloom.llm import divergence, merkle, mixing
from strandloom.llm.chat import chat_typed_parts, op10_chat_formatting
from strandloom.llm.decontaminate import op6_benchmark_decontamination
from strandloom.llm.divergence import op13_source_divergence
from strandloom.llm.embeddings import op4_embedding_near_dedup
from strandloom.llm.merkle import op11_merkle_manifest
from strandloom.llm.minhash import op7_minhash_near_dedup
from strandloom.llm.mixing import op12_source_mixing
from strandloom.llm.packing import op5_packing
from strandloom.llm.quality import op8_quality_classifier
from strandloom.llm.repeats import op2_suffix_dedup
from strandloom.llm.secrets import op1_secret_scan
from strandloom.llm.token_files import op3_token_files
from strandloom.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_token_files": op3_token_files,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_packing": op5_packing,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_toxicity": op9_toxicity,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_source_mixing": op12_source_mixing,
    "op13_source_divergence": op13_source_divergence,
    "chat_typed_parts": chat_typed_parts,
}

ORACLES = {
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_source_mixing": mixing.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
