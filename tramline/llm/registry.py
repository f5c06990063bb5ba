"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tramline.llm import oracles
from tramline.llm.bpe import op9_bpe
from tramline.llm.collocations import op11_phrase_collocations
from tramline.llm.linededup import op12_line_dedup
from tramline.llm.media import op8_media
from tramline.llm.packing import op1_packing
from tramline.llm.periodic import op13_periodic_runs
from tramline.llm.quality import op10_quality_rules
from tramline.llm.sharding import op4_sharding
from tramline.llm.simhash import op5_simhash
from tramline.llm.toxicity import op3_toxicity
from tramline.llm.urlfilter import op2_url_filter
from tramline.llm.warc import op6_warc
from tramline.llm.wrappers import op7_html_text


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_packing, op2_url_filter, op3_toxicity, op4_sharding, op5_simhash, op6_warc, op7_html_text, op8_media, op9_bpe, op10_quality_rules, op11_phrase_collocations, op12_line_dedup, op13_periodic_runs)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.SQL.items() if k in queries()}
