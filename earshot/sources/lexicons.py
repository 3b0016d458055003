"""Lexicon files: JSON maps or lists, standardised tables, labelled phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.operators.lexicon import labelled_phrases
from earshot.sources.tabular import read_delimited, require


def read_lexicon_json(spark: SparkSession, path: str) -> DataFrame:
    """``bucket, term`` of a JSON map of lists, or of a plain list (bucket ``all``)."""
    raw = spark.read.text(path, wholetext=True)
    as_map = F.from_json("value", "map<string,array<string>>")
    as_list = F.from_json("value", "array<string>")
    is_list = F.ltrim(F.regexp_replace("value", "^[﻿\\s]+", "")).startswith("[")
    maps = raw.where(~is_list).select(F.explode(as_map).alias("bucket", "terms"))
    lists = raw.where(is_list).select(F.lit("all").alias("bucket"), as_list.alias("terms"))
    return maps.union(lists).select("bucket", F.explode("terms").alias("term")).where("term is not null").distinct()


def read_standardized(spark: SparkSession, path: str) -> DataFrame:
    """``bucket, term, source, description`` without blanks and repeats; the columns must be there."""
    df = require(read_delimited(spark, path), ["bucket", "term"])
    for c in ("source", "description"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.select(F.trim("bucket").alias("bucket"), F.trim("term").alias("term"), "source", "description").where("bucket <> '' and term <> ''").dropDuplicates(["bucket", "term"])


def read_phrases(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """``phrase, label`` of lines ``phrase@label``."""
    lines = spark.read.option("encoding", encoding).text(path)
    return labelled_phrases(lines)
