"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, interactions, licenses, minhash, packing, pages, phrases, pseudonyms, quality, scoring, simhash, warc
from .sql import SQL

__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1_packing,
    "op2_pii": pseudonyms.op2_pii,
    "op3_simhash": simhash.op3_simhash,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_html_extraction": pages.op5_html_extraction,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_lm_scoring": scoring.op7_lm_scoring,
    "op8_warc": warc.op8_warc,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_filter_interaction": interactions.op11_filter_interaction,
    "op12_minhash": minhash.op12_minhash,
    "op13_collocations": phrases.op13_collocations,
}
