"""Registry of the corpus operators: `(spark, folder of tables) -> DataFrame`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from sitegauge.llm import decontaminate, html_text, lexical, minhash, mixing, negatives, ngramjoin, pii, preferences, quality, substrings, toxicity, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.query,
    "op2_html_text": html_text.query,
    "op3_minhash": minhash.query,
    "op4_pii": pii.query,
    "op5_url_filter": urlfilter.query,
    "op6_decontaminate": decontaminate.query,
    "op7_toxicity": toxicity.query,
    "op8_substrings": substrings.query,
    "op9_mixing": mixing.query,
    "op10_preferences": preferences.query,
    "op11_ngram_join": ngramjoin.query,
    "op12_search": lexical.query,
    "op13_negatives": negatives.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op5_url_filter": urlfilter.SQL,
    "op9_mixing": mixing.SQL,
    "op10_preferences": preferences.SQL,
    "op11_ngram_join": ngramjoin.SQL,
    "op12_search": lexical.SQL,
    "op13_negatives": negatives.SQL,
}
