"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from listwright.llm.infill import OP13_SQL, op13_infill
from listwright.llm.language import op6_language_id
from listwright.llm.licenses import op1_licenses
from listwright.llm.mpeg import op7_media
from listwright.llm.near import OP8_SQL, op8_near_dedup
from listwright.llm.packing import op9_packing
from listwright.llm.pieces import op4_sentencepiece
from listwright.llm.prefix_join import OP12_SQL, op12_ngram_join
from listwright.llm.privacy import op2_pii
from listwright.llm.secrets import op3_secrets
from listwright.llm.substring import OP5_SQL, op5_substring_dedup
from listwright.llm.topk import OP10_SQL, op10_topk
from listwright.llm.whiten import op11_whitening

QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_pii": op2_pii,
    "op3_secrets": op3_secrets,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_language_id": op6_language_id,
    "op7_media": op7_media,
    "op8_near_dedup": op8_near_dedup,
    "op9_packing": op9_packing,
    "op10_topk": op10_topk,
    "op11_whitening": op11_whitening,
    "op12_ngram_join": op12_ngram_join,
    "op13_infill": op13_infill,
}

#: SQL for the operators that it can express.
ORACLES: dict[str, str] = {
    "op5_substring_dedup": OP5_SQL,
    "op8_near_dedup": OP8_SQL,
    "op10_topk": OP10_SQL,
    "op12_ngram_join": OP12_SQL,
    "op13_infill": OP13_SQL,
}
