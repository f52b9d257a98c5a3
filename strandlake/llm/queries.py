"""The queries of this subpackage, and the DuckDB SQL that gives their rows."""

from __future__ import annotations

from strandlake.llm.bpe import op6_bpe
from strandlake.llm.hnsw import OP3_SQL, op3_hnsw
from strandlake.llm.html_text import op10_html_text
from strandlake.llm.language_id import op8_language_id
from strandlake.llm.mixing import op4_mixing
from strandlake.llm.order_minhash import op2_order_minhash
from strandlake.llm.quality_rules import OP11_SQL, op11_quality_rules
from strandlake.llm.simhash import op5_simhash
from strandlake.llm.spelling import OP13_SQL, op13_spelling_variants
from strandlake.llm.substring_dedup import OP7_SQL, op7_substring_dedup
from strandlake.llm.toxicity import op9_toxicity
from strandlake.llm.url_filter import OP1_SQL, op1_url_filters
from strandlake.llm.whitening import op12_whitening

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_order_minhash": op2_order_minhash,
    "op3_hnsw": op3_hnsw,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_bpe": op6_bpe,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language_id": op8_language_id,
    "op9_toxicity": op9_toxicity,
    "op10_html_text": op10_html_text,
    "op11_quality_rules": op11_quality_rules,
    "op12_whitening": op12_whitening,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLE_SQL = {
    "op1_url_filters": OP1_SQL,
    "op3_hnsw": OP3_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op11_quality_rules": OP11_SQL,
    "op13_spelling_variants": OP13_SQL,
}
