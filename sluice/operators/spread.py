"""Rows dealt over all tasks before costly work on each."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt anew by the columns `by` over the session's shuffle partitions. A file of a few megabytes may hold a million rows and is read by one
    task; a number of partitions that is asked for is not merged again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
