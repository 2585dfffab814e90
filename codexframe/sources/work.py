"""Where queries store what they build: a folder that driver and executors share."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, or under the warehouse where that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tasks_for(df: DataFrame, rows: int) -> int:
    """Partitions of about so many rows of df each: for rows that become many, which adaptive execution would put together by their bytes before.

    Given as a number of partitions; `repartition` by keys that a grouping went by already changes nothing.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / rows))


def dealt(df: DataFrame, *keys: str, rows: int = 20_000) -> DataFrame:
    """df over tasks of about so many rows: a small file is one split, however much work its rows are."""
    return df.repartition(tasks_for(df, rows), *keys)
