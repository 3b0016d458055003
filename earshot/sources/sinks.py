"""Writing results: columnar tables, delimited files, JSON, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """One Parquet dataset, partitioned if asked (K1, K3, K4)."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_delimited(df: DataFrame, path: str) -> None:
    """CSV parts with a header, written in parallel (K2)."""
    df.write.mode("overwrite").csv(path, header=True)


def write_json_rows(df: DataFrame, path: str) -> None:
    """One JSON object a row (K5)."""
    df.write.mode("overwrite").json(path)


def lexicon_json(lexicon: DataFrame) -> DataFrame:
    """``value``: the whole lexicon as one JSON map of sorted lists (K7)."""
    buckets = lexicon.groupBy("bucket").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return buckets.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "terms"))))).alias("value"))


def merged_statistics(old: DataFrame, new: DataFrame, stage: str = "stage") -> DataFrame:
    """Statistics by stage and key, new values in place of old ones (K6): write the result as a new version."""
    both = old.select(stage, "key", "value", F.lit(0).alias("v")).union(new.select(stage, "key", "value", F.lit(1)))
    return both.groupBy(stage, "key").agg(F.max_by("value", "v").alias("value"))


def preview(df: DataFrame, order: list[str], n: int = 50) -> DataFrame:
    """The first n rows in order (K8)."""
    return df.orderBy(*order).limit(n)


def skipped(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of the left table without a partner: the log of what did not match (K9)."""
    return left.join(right.select(key).distinct(), key, "left_anti")
