"""How much terms matter for the outcome, early and late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.tone import z_scores


def term_importance(scored: DataFrame, units: DataFrame, probs: DataFrame) -> DataFrame:
    """Add ``imp_early, imp_late, imp_delta = p (1 - p) unit_logit n_sent`` and their difference (M8, J19, J20); what is missing counts 0.

    ``scored`` needs company_id, z_label, role_early, role_late, cause_early,
    cause_late, early_n_sent, late_n_sent. Units are bounded by roles x causes x types.
    """
    out = scored
    for stage in ("early", "late"):
        u = units.select(F.col("role").alias(f"role_{stage}"), F.col("risk_bucket").alias(f"cause_{stage}"), "z_label", F.col("unit_logit").alias(f"u_{stage}"))
        out = out.join(F.broadcast(u), [f"role_{stage}", f"cause_{stage}", "z_label"], "left")
    out = out.join(probs, ["company_id", "z_label"], "left")
    p = F.coalesce("p", F.lit(0.0))
    value = lambda s: p * (1 - p) * F.coalesce(f"u_{s}", F.lit(0.0)) * F.coalesce(f"{s}_n_sent", F.lit(0))
    return out.withColumn("imp_early", value("early")).withColumn("imp_late", value("late")).withColumn("imp_delta", F.col("imp_late") - F.col("imp_early")).drop("u_early", "u_late")


def smallest_mode(column: str) -> Column:
    """The most frequent value, the smallest of ties; UNKNOWN if there is none."""
    return F.coalesce(F.mode(column, deterministic=True), F.lit("UNKNOWN"))


def summary(rows: DataFrame) -> DataFrame:
    """One row per company, term and type: means, modes, sums, the first early and the last late peak."""
    means = [F.avg(c).alias(c) for c in ("imp_early", "imp_late", "imp_delta", "term_score")]
    modes = [smallest_mode(c).alias(f"mode_{c}") for c in ("role_early", "role_late", "cause_early", "cause_late")]
    return rows.groupBy("company", "term", "z_label").agg(*means, *modes, F.count("*").alias("n_rows"), F.min("event_date").alias("event_date"), F.min("time_early").alias("time_early"), F.max("time_late").alias("time_late"), F.sum("early_n_sent").alias("early_n_sent"), F.sum("late_n_sent").alias("late_n_sent"))


def clean(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Rows with an event date whose importances are not all about 0 (F18); ``strict`` wants all three unlike 0."""
    zero = lambda c: F.abs(F.col(c)) <= 1e-8
    some = ~(zero("imp_early") & zero("imp_late") & zero("imp_delta"))
    every = (F.col("imp_early") != 0) & (F.col("imp_late") != 0) & (F.col("imp_delta") != 0)
    return rows.where(F.col("event_date").isNotNull() & (every if strict else some))


def group_top(rows: DataFrame, k: int = 10) -> DataFrame:
    """The k most sensitive rows of each type: z(|delta|) - z(score), then |delta|."""
    z = z_scores(rows.withColumn("abs_delta", F.abs("imp_delta")), ["abs_delta", "term_score"]).withColumn("sensitivity", F.round(F.col("abs_delta_z") - F.col("term_score_z"), 9))
    w = Window.partitionBy("z_label").orderBy(F.desc("sensitivity"), F.desc(F.round("abs_delta", 9)), "company", "term")
    return z.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cloud_weights(rows: DataFrame, top: int = 200) -> DataFrame:
    """``term, z_label, weight, rank`` of the top terms: total, 1.08 for several words, power 1.8 of its share of the largest, floor 0.01, the first two lifted."""
    by = rows.groupBy("term", "z_label").agg(F.sum(F.abs("imp_delta")).alias("w"))
    per = by.groupBy("term").agg(F.round(F.sum("w"), 9).alias("total"), F.min_by("z_label", F.struct(-F.round("w", 9), "z_label")).alias("z_label"))
    best = per.withColumn("total", F.when(F.contains("term", F.lit(" ")), F.col("total") * 1.08).otherwise(F.col("total"))).orderBy(F.desc("total"), "term").limit(top)
    w = Window.partitionBy().orderBy(F.desc("total"), "term")  # at most ``top`` rows
    ranked = best.withColumn("rank", F.row_number().over(w)).withColumn("largest", F.max("total").over(Window.partitionBy()))
    weight = F.greatest(F.pow(F.col("total") / (F.col("largest") + 1e-12), F.lit(1.8)), F.lit(0.01))
    return ranked.select("term", "z_label", (weight * F.when(F.col("rank") == 1, 3.5).when(F.col("rank") == 2, 2.0).otherwise(1.0)).alias("weight"), "rank")
