"""The corpus pipeline: toxicity, quality rules, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame: the first three the documents they keep, with their
columns, the last one the places of all documents in token sequences. Null, empty, repeated and very long texts, ties
and empty tables are handled as the operators' modules state; columns that the stages don't know are kept to the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tramline.llm.common import stored, table
from tramline.llm.packing import pack_stage
from tramline.llm.quality import filter_quality
from tramline.llm.simhash import keep_one
from tramline.llm.toxicity import filter_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", filter_toxic),
    ("quality_rules", filter_quality),
    ("simhash_near_dedup", keep_one),
    ("packing", pack_stage),
]

#: SQL can express neither the learned lexicon nor the tokens; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again as the next one's documents."""
    found = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        found = stored(stage(spark, found, sf_dir), name)
    return STAGES[-1][1](spark, found, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
