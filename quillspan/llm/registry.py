"""Queries of the subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from quillspan.llm.bpe import op7_token_counts
from quillspan.llm.decontaminate import OP6_SQL, op6_decontamination
from quillspan.llm.langid import op5_language
from quillspan.llm.media import op10_media
from quillspan.llm.neardup import OP1_SQL, op1_near_duplicates
from quillspan.llm.packing import op8_packing
from quillspan.llm.pii import op2_personal_data
from quillspan.llm.ppm import op3_lm_score
from quillspan.llm.sharding import OP4_SQL, op4_sharding
from quillspan.llm.urls import OP9_SQL, op9_url_filter
from quillspan.session import shipped

QUERIES = shipped({
    "op1_near_duplicates": op1_near_duplicates,
    "op2_personal_data": op2_personal_data,
    "op3_lm_score": op3_lm_score,
    "op4_sharding": op4_sharding,
    "op5_language": op5_language,
    "op6_decontamination": op6_decontamination,
    "op7_token_counts": op7_token_counts,
    "op8_packing": op8_packing,
    "op9_url_filter": op9_url_filter,
    "op10_media": op10_media,
})
ORACLES: dict[str, str] = {
    "op1_near_duplicates": OP1_SQL,
    "op4_sharding": OP4_SQL,
    "op6_decontamination": OP6_SQL,
    "op9_url_filter": OP9_SQL,
}
