"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from fleetcast.llm import hard_negatives, licences, merkle, topk, warc
from fleetcast.llm.byte_bpe import op1_byte_bpe
from fleetcast.llm.hard_negatives import op13_hard_negatives
from fleetcast.llm.katz import op10_katz_scores
from fleetcast.llm.language_id import op3_language_id
from fleetcast.llm.licences import op5_license_scan
from fleetcast.llm.merkle import op12_merkle_manifest
from fleetcast.llm.ngram_join import op2_ngram_join
from fleetcast.llm.packing import op4_packing
from fleetcast.llm.piece_bpe import op11_piece_bpe
from fleetcast.llm.quality_qda import op6_quality_qda
from fleetcast.llm.quality_rules import op8_quality_rules
from fleetcast.llm.topk import op7_top_k
from fleetcast.llm.warc import op9_warc_revisits

QUERIES = {f.__name__: f for f in (
    op1_byte_bpe,
    op2_ngram_join,
    op3_language_id,
    op4_packing,
    op5_license_scan,
    op6_quality_qda,
    op7_top_k,
    op8_quality_rules,
    op9_warc_revisits,
    op10_katz_scores,
    op11_piece_bpe,
    op12_merkle_manifest,
    op13_hard_negatives,
)}

ORACLE: dict[str, str] = {
    "op5_license_scan": licences.oracle(),
    "op7_top_k": topk.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "op9_warc_revisits": warc.ORACLE,
}
