"""Registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontaminate, html, language, lines, lm, mixing, negatives, neighbours, ngram_join, packing, ranked, repeats, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_backoff": lm.op1,
    "op2_mixing": mixing.op2,
    "op3_search": search.op3,
    "op4_html": html.op4,
    "op5_language": language.op5,
    "op6_lines": lines.op6,
    "op7_packing": packing.op7,
    "op8_ngram_join": ngram_join.op8,
    "op9_repeats": repeats.op9,
    "op10_neighbours": neighbours.op10,
    "op11_negatives": negatives.op11,
    "op12_ranked": ranked.op12,
    "op13_decontaminate": decontaminate.op13,
}

ORACLES: dict[str, str] = {
    "op1_backoff": lm.OP1_SQL,
    "op3_search": search.OP3_SQL,
    "op8_ngram_join": ngram_join.OP8_SQL,
    "op11_negatives": negatives.OP11_SQL,
    "op12_ranked": ranked.OP12_SQL,
    "op13_decontaminate": decontaminate.OP13_SQL,
}
