"""Registered queries of this subpackage, and their SQL twins for DuckDB where SQL expresses them."""

from __future__ import annotations

from .bpe import op4_byte_bpe
from .embedding_dedup import op5_embedding_dedup
from . import divergence, line_dedup, lm_scoring, spelling
from .divergence import op11_source_divergence
from .line_dedup import op13_line_dedup
from .lm_scoring import op7_lm_scoring
from .minhash_dedup import op10_minhash_dedup
from .packing import op2_best_fit_packing
from .pii import op1_pii
from .quality import op3_quality_resampling
from .spelling import op12_spelling_variants
from .substring_dedup import op9_substring_dedup
from .toxicity import op8_toxicity
from .vector_search import op6_vector_search

QUERIES = (op1_pii, op2_best_fit_packing, op3_quality_resampling, op4_byte_bpe, op5_embedding_dedup, op6_vector_search, op7_lm_scoring, op8_toxicity, op9_substring_dedup, op10_minhash_dedup, op11_source_divergence, op12_spelling_variants, op13_line_dedup)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op7_lm_scoring": lm_scoring.SQL, "op11_source_divergence": divergence.SQL, "op12_spelling_variants": spelling.SQL, "op13_line_dedup": line_dedup.SQL}
