"""The relations the queries start from, in Spark and, with the same names, as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earshot.functions import fixed
from earshot.functions.roles import canonical_role
from earshot.functions.text import type_number
from earshot.sources.tables import table

RISKS = fixed.RISKS
TONES = ["risk_lexical_intensity", "sentiment_score", "uncertainty_score", "hedging_score", "commitment_score", *[f"prob_{r}" for r in RISKS], "llm_pred_prob"]


def number(c: str) -> Column:
    """A double with null for NaN."""
    return F.when(~F.isnan(c), F.col(c))


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Term occurrences, each record once (the latest delivery), canonical role, z label, NaN as null."""
    t = table(spark, d, "term_occ")
    # a rank of one row per record: columns that a query doesn't need are still pruned from the scan
    latest = F.row_number().over(Window.partitionBy("rec_id").orderBy(F.desc("loaded_at"), F.desc("sentence_id"), F.desc_nulls_last("term")))
    once = t.where("rec_id is not null").withColumn("__r", latest).where("__r = 1").drop("__r")
    role = canonical_role(F.replace(F.col("speaker"), F.lit("."), F.lit("")))
    numbers = {c: number(c) for c in TONES}
    return once.withColumns({**numbers, "role": F.when(role != "", role).otherwise("Unknown"), "z_label": type_number(F.col("source_type"))})


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """One row a sentence: company, call, position, role, z, text and the four probabilities (null counts 0)."""
    o = occurrences(spark, d).where("company is not null")
    cols = ["call_id", "sentence_id", "company", "file_date", "role", "z_label", "sentence_text", *[f"prob_{r}" for r in RISKS], "llm_pred_prob"]
    first = F.row_number().over(Window.partitionBy("call_id", "sentence_id").orderBy("rec_id"))
    one = o.withColumn("__r", first).where("__r = 1").select(*cols)
    return one.fillna(0.0, [f"prob_{r}" for r in RISKS])


def terms(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences with a usable term: lower case, single spaces."""
    o = occurrences(spark, d)
    term = F.trim(F.regexp_replace(F.lower(F.col("term")), r"\s+", " "))
    return o.withColumn("term", term).where("term <> '' and company is not null")


_ALIASES = " ".join(f"WHEN contains(x, '{a}') THEN '{r}'" for a, r in fixed.ROLE_ALIASES)
_CLEAN = ", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in TONES)
#: Start of every SQL text: the same relations in DuckDB.
SQL = rf"""
WITH occ AS (
  SELECT * REPLACE ({_CLEAN}), coalesce(CASE {_ALIASES} END, 'Unknown') AS role,
    try_cast(nullif(regexp_extract(source_type, 'Type_([123])', 1), '') AS INT) AS z_label
  FROM (SELECT *, regexp_replace(trim(lower(regexp_replace(replace(coalesce(speaker, ''), '.', ''), '[^A-Za-z\s]', ' ', 'g'))), '\s+', ' ', 'g') AS x FROM term_occ
        WHERE rec_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at DESC, sentence_id DESC, term DESC NULLS LAST) = 1)),
sent AS (
  SELECT call_id, sentence_id, company, file_date, role, z_label, sentence_text, {", ".join(f"coalesce(prob_{r}, 0) AS prob_{r}" for r in RISKS)}, llm_pred_prob
  FROM occ WHERE company IS NOT NULL QUALIFY row_number() OVER (PARTITION BY call_id, sentence_id ORDER BY rec_id) = 1),
terms AS (
  SELECT * FROM (SELECT * REPLACE (trim(regexp_replace(lower(term), '\s+', ' ', 'g')) AS term) FROM occ) WHERE term <> '' AND company IS NOT NULL)
"""


def sql_list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
