"""Stages of a company's history, tone windows and the shift from early to late."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions.text import first_max
from earshot.operators.skew import exact_quantile, salted_lookup
from earshot.session import cut


def company_stages(rows: DataFrame, company: str = "company", date: str = "file_date") -> DataFrame:
    """``company, file_date, time_index, stage`` of each distinct call date.

    With n dates the first third is early, the second mid, the rest late; one
    date is early, two are early and mid. Ranks run over distinct dates only.
    """
    dates = rows.where(F.col(company).isNotNull() & F.col(date).isNotNull()).select(company, date).distinct()
    w = Window.partitionBy(company)
    ranked = dates.withColumn("time_index", F.row_number().over(w.orderBy(date)) - 1).withColumn("n", F.count("*").over(w))
    early = F.greatest(F.lit(0), F.floor(F.col("n") / 3) - 1)
    mid = F.greatest(early + 1, F.floor(F.col("n") * 2 / 3) - 1)
    stage = F.when(F.col("time_index") <= early, "early").when(F.col("time_index") <= mid, "mid").otherwise("late")
    return ranked.select(company, date, "time_index", stage.alias("stage"))


def with_stage(rows: DataFrame, company: str = "company", date: str = "file_date") -> DataFrame:
    """Rows with their stage; the lookup is salted, a company may hold a third of all rows."""
    return salted_lookup(rows, company_stages(rows, company, date), [company, date], salts=4)


def windows(rows: DataFrame, measures: list[str], least: int = 5) -> DataFrame:
    """Means of the measures by company, term, role and stage with at least ``least`` sentences."""
    out = rows.groupBy("company", "term", "role", "stage").agg(*[F.avg(m).alias(m) for m in measures], F.count("*").alias("n_sentences"))
    return out.where(F.col("n_sentences") >= least)


def shifts(window: DataFrame, measures: list[str], causes: list[str]) -> DataFrame:
    """``company, term, role, d, early_n, late_n, cause_early, cause_late``: distance between early and late.

    Only groups with all measures in both stages count. Each measure is divided
    by its sample deviation over all early and late values; deviations up to
    1e-6 count 1. The deviations are one row.
    """
    at = lambda stage, c: F.max(F.when(F.col("stage") == stage, F.col(c)))
    wide = window.where("stage in ('early', 'late')").groupBy("company", "term", "role").agg(*[at(s, m).alias(f"{s}_{m}") for s in ("early", "late") for m in [*measures, "n_sentences"]])
    both = wide.dropna(how="any", subset=[f"{s}_{m}" for s in ("early", "late") for m in measures])
    n = F.count("*") * 2

    def deviation(m: str):
        total = F.sum(F.col(f"early_{m}") + F.col(f"late_{m}"))
        squares = F.sum(F.col(f"early_{m}") * F.col(f"early_{m}") + F.col(f"late_{m}") * F.col(f"late_{m}"))
        s = F.sqrt(F.greatest(F.try_divide(squares - total * total / n, n - 1), F.lit(0.0)))
        return F.when(F.coalesce(s, F.lit(0.0)) <= 1e-6, 1.0).otherwise(s).alias(f"s_{m}")

    joined = both.crossJoin(F.broadcast(both.agg(*[deviation(m) for m in measures])))
    square = reduce(lambda a, m: a + F.pow((F.col(f"late_{m}") - F.col(f"early_{m}")) / F.col(f"s_{m}"), F.lit(2)), measures, F.lit(0.0))
    cause = lambda s: first_max({c: F.col(f"{s}_prob_{c}") for c in causes})
    return joined.select("company", "term", "role", F.sqrt(square).alias("d"), F.col("early_n_sentences").alias("early_n"), F.col("late_n_sentences").alias("late_n"), cause("early").alias("cause_early"), cause("late").alias("cause_late"))


def z_scores(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``<column>_z``: over the sample deviation, 1 where that is null or up to 1e-6."""
    stats = rows.agg(*[F.avg(c).alias(f"__m{k}") for k, c in enumerate(columns)], *[F.stddev_samp(c).alias(f"__s{k}") for k, c in enumerate(columns)])
    out = rows.crossJoin(F.broadcast(stats))
    for k, c in enumerate(columns):
        s = F.when(F.coalesce(f"__s{k}", F.lit(0.0)) <= 1e-6, 1.0).otherwise(F.col(f"__s{k}"))
        out = out.withColumn(f"{c}_z", (F.col(c) - F.col(f"__m{k}")) / s)
    return out.drop(*[f"__{x}{k}" for x in "ms" for k in range(len(columns))])


def scores(shift: DataFrame, window: DataFrame, least: int = 5, quantile: float = 0.8) -> DataFrame:
    """Score of each (company, term) and whether it is in the top fifth.

    The main speaker is the role of the largest shift, the first of ties;
    coverage sums the windows of a stage over all roles.
    """
    top = F.max_by(F.struct("role", "cause_early", "cause_late"), F.struct("d", F.translate("role", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcbaZYXWVUTSRQPONMLKJIHGFEDCBA")))
    per = shift.groupBy("company", "term").agg(F.max("d").alias("d_max"), F.median("d").alias("d_med"), F.countDistinct("role").alias("speakers_count"), top.alias("top"))
    per = z_scores(per, ["d_max", "d_med"]).withColumn("term_score", 0.7 * F.col("d_max_z") + 0.3 * F.col("d_med_z"))
    cover = window.groupBy("company", "term").agg(*[F.sum(F.when(F.col("stage") == s, F.col("n_sentences")).otherwise(0)).alias(f"{s}_n_sent") for s in ("early", "late")])
    kept = per.join(cover, ["company", "term"]).where((F.col("early_n_sent") >= least) & (F.col("late_n_sent") >= least))
    kept = cut(kept)  # one row a company and term; counted several times for the edge
    edge = exact_quantile(kept, "term_score", quantile)
    out = kept.crossJoin(F.broadcast(edge))
    return out.select("company", "term", "d_max", "d_med", "speakers_count", F.col("top.role").alias("main_role"), "top.cause_early", "top.cause_late", "term_score", "early_n_sent", "late_n_sent", (F.col("term_score") >= F.col("edge")).alias("is_significant"))


def peak_dates(rows: DataFrame) -> DataFrame:
    """``company, term, stage, peak``: the date with most occurrences, the earliest of ties."""
    n = rows.groupBy("company", "term", "stage", "file_date").agg(F.count("*").alias("n"))
    return n.groupBy("company", "term", "stage").agg(F.max_by("file_date", F.struct("n", -F.unix_date("file_date"))).alias("peak"))
