"""The registered queries of this subpackage: one thin query per operator, and the parts of them that SQL can state."""

from __future__ import annotations

from . import codes, langid, media, ngramjoin, packing, pieces, pii, quality, resample, simhash, suffixes, toxicity, urls

QUERIES = {
    "op10_pii_disclosure": pii.op10_pii_disclosure,
    "op2_language_id": langid.op2_language_id,
    "op1_packing_drr": packing.op1_packing_drr,
    "op3_suffix_dedup": suffixes.op3_suffix_dedup,
    "op4_pieces_prefix_table": pieces.op4_pieces_prefix_table,
    "op5_quality_gbt": quality.op5_quality_gbt,
    "op6_url_filter": urls.op6_url_filter,
    "op7_simhash_bktree": simhash.op7_simhash_bktree,
    "op8_toxicity_lexicon": toxicity.op8_toxicity_lexicon,
    "op9_media_columns": media.op9_media_columns,
    "op11_target_resampling": resample.op11_target_resampling,
    "op12_vector_codes": codes.op12_vector_codes,
    "op13_ngram_join": ngramjoin.op13_ngram_join,
    "url_rules": urls.url_rules,
    "quality_base": quality.quality_base,
    "media_payloads": media.media_payloads,
    "page_sequences": media.page_sequences,
    "pii_base": pii.pii_base,
}

#: None of the first ten can be stated in SQL as a whole; these hold the columns that can.
ORACLE_SQL: dict[str, str] = {
    "op11_target_resampling": resample.OP11_SQL,
    "op12_vector_codes": codes.OP12_SQL,
    "op13_ngram_join": ngramjoin.OP13_SQL,
    "url_rules": urls.URL_RULES_SQL,
    "quality_base": quality.QUALITY_BASE_SQL,
    "media_payloads": media.MEDIA_PAYLOADS_SQL,
    "pii_base": pii.PII_BASE_SQL,
}
