"""Queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from .fingerprint import op3_order_minhash
from .langid import op5_language_id
from .linkgraph import op7_link_graph, op7_sql
from .mixing import OP4_SQL, op4_curriculum_mix
from .neardup import OP10_SQL, op10_multi_index_hamming
from .packing import op6_best_fit_packing
from .preference import OP9_SQL, op9_preference_format
from .quality import op1_compression_bands
from .substring import OP8_SQL, op8_super_kmers
from .toxicity import op2_toxicity_cnn


def queries() -> dict:
    return {f.__name__: f for f in (op1_compression_bands, op2_toxicity_cnn, op3_order_minhash, op4_curriculum_mix, op5_language_id, op6_best_fit_packing, op7_link_graph, op8_super_kmers, op9_preference_format, op10_multi_index_hamming)}


def oracle_sql() -> dict[str, str]:
    return {"op4_curriculum_mix": OP4_SQL, "op7_link_graph": op7_sql(), "op8_super_kmers": OP8_SQL, "op9_preference_format": OP9_SQL, "op10_multi_index_hamming": OP10_SQL}
