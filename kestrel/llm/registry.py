"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from kestrel.llm import alignment, collocations, fingerprints, jaccard_join, line_dedup, neighbours, packing, quality, secret_scan, sentence_pieces, token_counts, toxicity, url_filters


def queries() -> dict:
    return {
        "op1_document_fingerprints": fingerprints.op1_document_fingerprints,
        "op10_sentence_pieces": sentence_pieces.op10_sentence_pieces,
        "op11_phrase_collocations": collocations.op11_phrase_collocations,
        "op12_cross_tokenizer_alignment": alignment.op12_cross_tokenizer_alignment,
        "op13_toxicity": toxicity.op13_toxicity,
        "op2_nearest_neighbours": neighbours.op2_nearest_neighbours,
        "op3_packing": packing.op3_packing,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_secret_scans": secret_scan.op5_secret_scans,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_ngram_jaccard_join": jaccard_join.op7_ngram_jaccard_join,
        "op8_url_filters": url_filters.op8_url_filters,
        "op9_quality_classifier": quality.op9_quality_classifier,
    }


def oracle_sql() -> dict:
    return {"op8_url_filters": url_filters.OP8_SQL, "op11_phrase_collocations": collocations.OP11_SQL}
