"""Small relational operators shared by the stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.fixed import RISK_LABELS, RISKS
from earshot.operators.cubes import hash_order


def risk_distance(direct: Column | None, near: list[Column], similar: list[Column]) -> Column:
    """Distance to risk: the direct value, else the least of the near/distance columns, else one minus the largest similarity, else 1 (M2).

    The near columns hold counts and ratios, so no risk nearby gives distance 0
    and full weight: that is the defined behaviour (T2).
    """
    least = (F.least(*near) if len(near) > 1 else near[0]) if near else F.lit(None).cast("double")
    most = (F.greatest(*similar) if len(similar) > 1 else similar[0]) if similar else F.lit(None).cast("double")
    return F.coalesce(direct if direct is not None else F.lit(None).cast("double"), least, 1 - most, F.lit(1.0))


def sample_weight(distance: Column) -> Column:
    """1 - distance between 0.05 and 1 (M3)."""
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), 1 - distance))


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first n rows in the order of a hash: a sample that any run repeats."""
    return rows.orderBy(hash_order(key, seed=seed), key).limit(n)


def lookup_with_fallback(rows: DataFrame, documents: DataFrame, key: str, document: str, prefix: Column, document_prefix: Column) -> DataFrame:
    """``key, document, how``: the document of the same key, else the least one of the same prefix."""
    exact = documents.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(document).alias("__exact"))
    loose = documents.where(document_prefix.isNotNull()).groupBy(document_prefix.alias("__prefix")).agg(F.min(document).alias("__loose"))
    out = rows.select(key).distinct().join(exact, key, "left").withColumn("__prefix", prefix).join(loose, "__prefix", "left")
    how = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__loose").isNotNull(), "prefix").otherwise("none")
    return out.select(key, F.coalesce("__exact", "__loose").alias(document), how.alias("how"))


def reindex(rows: DataFrame, domain: DataFrame, keys: list[str], values: list[str], fill: float = 0.0) -> DataFrame:
    """One row for each key of a fixed domain, the fill value where the table has none."""
    return domain.join(rows, keys, "left").fillna(fill, values).select(*keys, *values)


def split_coefficients(coefs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(role, risk_bucket, z_label, coef)`` of the pair features and ``(z_label, k, coef)`` of the priors; intercepts go."""
    real = coefs.where(~F.lower("feature").isin("intercept", "const", "bias"))
    gamma = real.where(F.col("feature").startswith("prior_z")).select("z_label", F.regexp_extract("feature", r"prior_z(\d)", 1).try_cast("int").alias("k"), "coef")
    beta = real.where(~F.col("feature").startswith("prior_z")).select(F.split_part("feature", F.lit("|"), F.lit(1)).alias("role"), F.split_part("feature", F.lit("|"), F.lit(2)).alias("risk_bucket"), "z_label", "coef")
    return beta, gamma


def union_last_wins(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """Two maps as tables; the second one's values stand."""
    both = first.select(key, value, F.lit(0).alias("__o")).union(second.select(key, value, F.lit(1)))
    return both.groupBy(key).agg(F.max_by(value, "__o").alias(value))


def collapse_labels(values: dict[str, Column], unknown: str = "risk_uncertainty") -> dict[str, Column]:
    """Sums of label probabilities by canonical cause; labels of no cause count as ``unknown`` (M4)."""
    out: dict[str, Column] = {r: F.lit(0.0) for r in RISKS}
    for label, column in values.items():
        low = "".join(c for c in label.lower() if c.isalnum())
        cause = next((name for name, words in RISK_LABELS if any(w in low for w in words)), unknown)
        out[cause] = out[cause] + F.coalesce(column, F.lit(0.0))
    return out


def with_type(rows: DataFrame, source: str, path: str, by_document: DataFrame, document: str) -> DataFrame:
    """The type of a row: as given, else from its path, else from its document."""
    known = by_document.select(document, F.col(source).alias("__known")).where(F.col("__known").isNotNull()).groupBy(document).agg(F.min("__known").alias("__known"))
    from_path = F.nullif(F.regexp_extract(path, "(Type_[123])", 1), F.lit(""))
    return rows.join(known, document, "left").withColumn(source, F.coalesce(source, from_path, "__known")).drop("__known")

