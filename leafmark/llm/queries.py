"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from leafmark.llm.alignment import op12_alignment
from leafmark.llm.decontamination import op2_decontamination
from leafmark.llm.fingerprints import op8_fingerprints
from leafmark.llm.html_extraction import op6_html_extraction
from leafmark.llm.importance import op11_importance
from leafmark.llm.jaccard_join import op5_jaccard_join
from leafmark.llm.language_id import op3_language_id
from leafmark.llm.license_scan import op1_license_scan
from leafmark.llm.near_dedup import op13_near_dedup
from leafmark.llm.oracle import ORACLE_SQL
from leafmark.llm.quality import op7_quality
from leafmark.llm.sentencepiece_codec import op9_sentencepiece
from leafmark.llm.token_files import op10_token_files
from leafmark.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_html_extraction": op6_html_extraction,
    "op7_quality": op7_quality,
    "op8_fingerprints": op8_fingerprints,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_token_files": op10_token_files,
    "op11_importance": op11_importance,
    "op12_alignment": op12_alignment,
    "op13_near_dedup": op13_near_dedup,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
