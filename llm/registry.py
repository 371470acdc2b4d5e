"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import quality_rules, token_counts
from .alignment import op11_alignment
from .bpe import op10_bpe
from .conversations import op12_conversations
from .decontaminate import op3_decontaminate
from .language_id import op7_language_id
from .licenses import op8_license_scan
from .line_dedup import op1_line_dedup
from .near_duplicates import op4_near_duplicates
from .quality_gam import op5_quality_gam
from .simhash import op13_simhash
from .toxicity import op6_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_decontaminate": op3_decontaminate,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_quality_gam": op5_quality_gam,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_license_scan": op8_license_scan,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_bpe": op10_bpe,
    "op11_alignment": op11_alignment,
    "op12_conversations": op12_conversations,
    "op13_simhash": op13_simhash,
}
ORACLES: dict[str, str] = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op9_token_counts": token_counts.ORACLE,
}
