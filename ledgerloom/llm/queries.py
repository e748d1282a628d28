"""Registry of this subpackage's queries."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, gif, jaccard, packing, pages, pii, quality, ranking, secrets, suffixes, toxicity, warc, whitening


def queries():
    return {
        "pipeline": corpus_pipeline.run,
        "op5_suffix_dedup": suffixes.query,
        "op3_ngram_jaccard": jaccard.query,
        "op7_toxicity": toxicity.query,
        "op1_gif_media": gif.query,
        "op10_pii": pii.query,
        "op8_warc": warc.query,
        "op9_packing": packing.query,
        "op4_bpe": bpe.query,
        "op2_secret_scan": secrets.query,
        "op6_quality_rules": quality.query,
        "op11_ranked_search": ranking.query,
        "op12_html_text": pages.query,
        "op13_whitening": whitening.query,
    }


def oracle_sql():
    return {
        "op8_warc": warc.ORACLE_SQL,
        "op11_ranked_search": ranking.ORACLE_SQL,
    }
