"""The subpackage's queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm.bpe import op3_bpe
from tidemark.llm.collocations import OP13_SQL, op13_collocations
from tidemark.llm.decontamination import op5_decontamination
from tidemark.llm.embeddings import op1_embedding_graph
from tidemark.llm.line_templates import op4_line_templates
from tidemark.llm.merkle import OP11_SQL, op11_merkle_manifest
from tidemark.llm.minhash import op9_minhash_forest
from tidemark.llm.paragraphs import op10_paragraphs
from tidemark.llm.pii import op7_personal_data
from tidemark.llm.quality import op12_line_quality
from tidemark.llm.suffixes import op8_suffix_dedup
from tidemark.llm.toxicity import op6_toxicity
from tidemark.llm.urls import OP2_SQL, op2_url_filter

QUERIES = {
    "op1_embedding_graph": op1_embedding_graph,
    "op2_url_filter": op2_url_filter,
    "op3_bpe": op3_bpe,
    "op4_line_templates": op4_line_templates,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_personal_data": op7_personal_data,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_minhash_forest": op9_minhash_forest,
    "op10_paragraphs": op10_paragraphs,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_line_quality": op12_line_quality,
    "op13_collocations": op13_collocations,
}

SQL = {
    "op2_url_filter": OP2_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op13_collocations": OP13_SQL,
}
