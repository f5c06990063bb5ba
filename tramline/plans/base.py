"""The list of queries: each a function of (spark, sf_dir) with its DuckDB SQL, where SQL can express it."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is there already")
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the one that driver and executors share (spark.checkpoint.dir; where unset on one machine, a local one)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as read from a new folder, so that several readers don't make its rows again."""
    out = scratch(df.sparkSession, label)
    df.write.parquet(out)
    return df.sparkSession.read.parquet(out)
