"""The queries and SQL of this subpackage, by name."""

from __future__ import annotations

from .decontamination import op2_decontamination
from .language_id import op6_language_id
from .line_dedup import OP10_SQL, op10_line_dedup
from .lm_scores import OP9_SQL, op9_lm_scores
from .media_chunks import op3_media_chunks
from .near_dedup import OP5_SQL, op5_near_dedup
from .packing import op4_packing
from .sharding import op8_sharding
from .token_count import op7_token_counts
from .toxicity import op1_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_decontamination, op3_media_chunks, op4_packing, op5_near_dedup, op6_language_id, op7_token_counts, op8_sharding, op9_lm_scores, op10_line_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {"op5_near_dedup": OP5_SQL, "op9_lm_scores": OP9_SQL, "op10_line_dedup": OP10_SQL}
