"""Transcript files: whole texts whose path names type, company, date and quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions.text import document_parts, type_number


def read_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """``doc_id, source_type, z_label, company, company_id, file_date, quarter, fiscal_year, text`` of ``root/Type_[123]/*.txt``.

    The path is percent-encoded by the reader and decoded here; a plus sign in
    a name stays one. Names that do not follow the pattern have null parts.
    """
    raw = spark.read.text(f"{root}/Type_[123]/*.txt", wholetext=True)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = raw.select(F.col("value").alias("text"), path.alias("path"))
    rows = rows.withColumn("doc_id", F.regexp_extract("path", r"([^/]+)\.txt$", 1))
    z = type_number(F.col("path"))
    return rows.select("doc_id", F.concat(F.lit("Type_"), z).alias("source_type"), z.alias("z_label"), *[c.alias(n) for n, c in document_parts(F.col("doc_id")).items()], "text")


def quality(documents: DataFrame, least: int = 130) -> DataFrame:
    """Add ``is_stub``: texts of at most ``least`` characters are viewer stubs, not calls (T16). Nothing is dropped."""
    return documents.withColumn("is_stub", F.length(F.trim(F.coalesce("text", F.lit("")))) <= least)


def best_variant(rows: DataFrame, key: list[str], kind: str) -> DataFrame:
    """One transcript of each key: indexed before corrected, raw and other kinds (S18's ranking), the smallest id of ties."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    rank = F.when(F.contains(low, F.lit("indexed")), 1).when(F.contains(low, F.lit("corrected")), 5).when(F.contains(low, F.lit("raw")), 20).otherwise(25)
    columns = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct(rank, *columns)).alias("r")).select(*key, "r.*")
