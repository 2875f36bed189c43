"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, embedding_dedup, fill_in_middle, hard_negatives, html_extraction, line_dedup, media, mixing, ngram_jaccard, packing, pii, secrets, toxicity


def queries() -> dict:
    return {
        "op1_ngram_jaccard_join": ngram_jaccard.op1_ngram_jaccard_join,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_bpe": bpe.op3_bpe,
        "op10_media": media.op10_media,
        "pipeline": corpus_pipeline.run,
        "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_pii": pii.op6_pii,
        "op7_html_text": html_extraction.op7_html_text,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_mixing": mixing.op9_mixing,
        "op11_packing": packing.op11_packing,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": ngram_jaccard.OP1_SQL,
        "op4_embedding_dedup": embedding_dedup.OP4_SQL,
        "op5_line_dedup": line_dedup.OP5_SQL,
        "op6_pii": pii.OP6_SQL,
        "op9_mixing": mixing.OP9_SQL,
        "op12_hard_negatives": hard_negatives.OP12_SQL,
        "op13_fill_in_middle": fill_in_middle.OP13_SQL,
    }
