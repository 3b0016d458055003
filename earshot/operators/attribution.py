"""Contributions of role x cause to the outcome of a company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.common import split_coefficients


def unit_logits(fijz: DataFrame, beta: DataFrame, gamma: DataFrame) -> DataFrame:
    """``role, risk_bucket, z_label, unit_logit`` = beta + sum over k of gamma(z, k) f(k) (M7).

    Every (role, cause) of either side meets each of the three types; what is missing counts 0.
    """
    pairs = fijz.select("role", "risk_bucket").union(beta.select("role", "risk_bucket")).distinct()
    grid = pairs.withColumn("z_label", F.explode(F.array(*[F.lit(z) for z in (1, 2, 3)])))
    prior = fijz.groupBy("role", "risk_bucket").agg(*[F.max(F.when(F.col("z_label") == k, F.col("f_ijz"))).alias(f"f{k}") for k in (1, 2, 3)])
    out = grid.join(beta, ["role", "risk_bucket", "z_label"], "left").join(prior, ["role", "risk_bucket"], "left").join(F.broadcast(gamma), "z_label", "left")
    via = sum((F.coalesce(F.col(f"g{k}") * F.col(f"f{k}"), F.lit(0.0)) for k in (1, 2, 3)), F.lit(0.0))
    return out.select("role", "risk_bucket", "z_label", (F.coalesce("coef", F.lit(0.0)) + via).alias("unit_logit"))


def logit_contributions(share: DataFrame, units: DataFrame, company: str) -> DataFrame:
    """``company, role, risk_bucket, z_label, a_mij, c_logit`` (M5, J11): one row per share and type."""
    # roles x causes x types: bounded by the role list
    return share.join(F.broadcast(units), ["role", "risk_bucket"]).select(company, "role", "risk_bucket", "z_label", "a_mij", (F.col("a_mij") * F.col("unit_logit")).alias("c_logit"))


def prob_contributions(contributions: DataFrame, probs: DataFrame, company: str) -> DataFrame:
    """Add ``delta`` from the mean of (role, cause, type) and ``c_prob = p (1 - p) delta``; no probability counts 0."""
    mean = contributions.groupBy("role", "risk_bucket", "z_label").agg(F.avg("c_logit").alias("__mean"))
    out = contributions.join(F.broadcast(mean), ["role", "risk_bucket", "z_label"]).join(probs, [company, "z_label"], "left")
    p = F.coalesce("p", F.lit(0.0))
    delta = F.col("c_logit") - F.col("__mean")
    return out.select(company, "role", "risk_bucket", "z_label", "a_mij", "c_logit", delta.alias("delta"), (p * (1 - p) * delta).alias("c_prob"))


def top_k(rows: DataFrame, company: str, value: str, k: int = 10) -> DataFrame:
    """The k rows of each company with the largest absolute value."""
    w = Window.partitionBy(company).orderBy(F.desc(F.abs(value)), "role", "risk_bucket", "z_label")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def star(probs: DataFrame, company: str) -> DataFrame:
    """``company, z_star``: the type of the largest probability, the smallest of ties."""
    return probs.where("p is not null").groupBy(company).agg(F.min_by("z_label", F.struct(-F.col("p"), F.col("z_label"))).alias("z_star"))


def at_star(rows: DataFrame, stars: DataFrame, company: str) -> DataFrame:
    """The rows of each company's own type."""
    return rows.join(stars, company).where(F.col("z_label") == F.col("z_star")).drop("z_star")


def coefficient_units(fijz: DataFrame, coefs: DataFrame) -> DataFrame:
    """Unit logits from the coefficients of a fitted surrogate: those of ``role|cause`` and of ``prior_z1..3``."""
    beta, gamma = split_coefficients(coefs)
    wide = gamma.groupBy("z_label").agg(*[F.max(F.when(F.col("k") == k, F.col("coef"))).alias(f"g{k}") for k in (1, 2, 3)])
    return unit_logits(fijz, beta, wide)


def roll_ups(rows: DataFrame, company: str) -> DataFrame:
    """Sums by (company, role, type) and by (company, cause, type) in one scan."""
    out = rows.groupingSets([[company, "role", "z_label"], [company, "risk_bucket", "z_label"]], company, "role", "risk_bucket", "z_label")
    return out.agg(F.sum("c_logit").alias("c_logit"), F.sum("c_prob").alias("c_prob"))


def winners(rows: DataFrame, company: str, key: str, value: str = "c_prob") -> DataFrame:
    """``z_label, company, winner``: the key with the largest sum, the smallest of ties."""
    sums = rows.groupBy("z_label", company, key).agg(F.round(F.sum(value), 12).alias("s"))
    low = Window.partitionBy("z_label", company).orderBy(F.desc("s"), key)
    return sums.withColumn("__r", F.row_number().over(low)).where("__r = 1").select("z_label", company, F.col(key).alias("winner"))


def winner_share(won: DataFrame) -> DataFrame:
    """``z_label, winner, n, total, share``."""
    n = won.groupBy("z_label", "winner").agg(F.count("*").alias("n"))
    total = Window.partitionBy("z_label")
    return n.withColumn("total", F.sum("n").over(total)).withColumn("share", F.col("n") / F.col("total"))


def wilson(k: Column, n: Column, z: float = 1.96) -> dict[str, Column]:
    """Centre and bounds of the Wilson interval, 0 without trials."""
    p = F.try_divide(k, n)
    denominator = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), 2 * n)) / denominator
    half = z / denominator * F.sqrt(F.try_divide(p * (1 - p) + F.try_divide(F.lit(z * z), 4 * n), n))
    zero = lambda c: F.when(n > 0, c).otherwise(0.0)
    return {"centre": zero(centre), "low": zero(F.greatest(centre - half, F.lit(0.0))), "high": zero(F.least(centre + half, F.lit(1.0)))}


def positive_share(rows: DataFrame, company: str, value: str) -> DataFrame:
    """Add ``share``: positive part over its sum in the company and type, absolute values if none is positive."""
    w = Window.partitionBy(company, "z_label")
    any_positive = F.max((F.col(value) > 0).cast("int")).over(w) == 1
    plus = F.greatest(F.col(value), F.lit(0.0))
    share = F.when(any_positive, plus / F.greatest(F.sum(plus).over(w), F.lit(1e-9))).otherwise(F.abs(value) / F.greatest(F.sum(F.abs(value)).over(w), F.lit(1e-9)))
    return rows.withColumn("share", share)
