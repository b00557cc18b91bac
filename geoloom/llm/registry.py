"""The subpackage's registered queries: name -> (callable of session and folder, checking SQL or None)."""

from __future__ import annotations

import corpus_pipeline
from geoloom.llm import (
    alignment, centroids, decontaminate, langid, mixing, preferences, quality, simhash, suffixdedup, toxicity, urlfilter, warc, wrapper,
)


def load() -> dict:
    return {
        "op1_toxicity": (toxicity.report, None),
        "op2_mixing": (mixing.report, None),
        "op3_suffix_dedup": (suffixdedup.report, None),
        "op4_preferences": (preferences.report, preferences.SQL),
        "op5_warc": (warc.report, warc.SQL),
        "op6_decontaminate": (decontaminate.report, decontaminate.SQL),
        "op7_quality": (quality.report, quality.SQL),
        "op8_simhash": (simhash.report, None),
        "op9_urlfilter": (urlfilter.report, urlfilter.SQL),
        "op10_wrapper": (wrapper.report, wrapper.SQL),
        "op11_langid": (langid.report, None),
        "op12_centroids": (centroids.report, centroids.SQL),
        "op13_alignment": (alignment.report, None),
        "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
    }
