"""Role x cause x company cubes, priors, features and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.skew import at_ranks
from earshot.session import cut

from earshot.functions import fixed


def shares(rows: DataFrame, keys: list[str], risks: list[str] = fixed.RISKS) -> DataFrame:
    """``keys, risk_bucket, sum_prob, n_sent, a_mij``: share of each cause in a group's probability mass, 0 without mass."""
    sums = rows.groupBy(*keys).agg(*[F.sum(f"prob_{r}").alias(r) for r in risks], F.count("*").alias("n_sent"))
    sums = sums.withColumn("total", sum((F.col(r) for r in risks[1:]), F.col(risks[0])))
    long = sums.unpivot([*keys, "n_sent", "total"], risks, "risk_bucket", "sum_prob")
    return long.select(*keys, "risk_bucket", "sum_prob", "n_sent", F.when(F.col("total") > 0, F.col("sum_prob") / F.col("total")).otherwise(0.0).alias("a_mij"))


def pool(rows: DataFrame, keys: list[str], risks: list[str] = fixed.RISKS) -> DataFrame:
    """``keys, risk_bucket, sum_s, mean_s, n_sent`` (A10). Sums are folded before they are unpivoted."""
    sums = rows.groupBy(*keys).agg(*[F.sum(f"prob_{r}").alias(r) for r in risks], F.count("*").alias("n_sent"))
    long = sums.unpivot([*keys, "n_sent"], risks, "risk_bucket", "sum_s")
    return long.select(*keys, "risk_bucket", "sum_s", (F.col("sum_s") / F.col("n_sent")).alias("mean_s"), "n_sent")


def majority_label(rows: DataFrame, key: str, label: str) -> DataFrame:
    """``key, label, n``: the most frequent label, the smallest of ties."""
    n = rows.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.max_by(F.struct(label, "n"), F.struct("n", -F.col(label))).alias("b")).select(key, f"b.{label}", "b.n")


def log_ratio(pooled: DataFrame, alpha: float = fixed.ALPHA, least: int = fixed.MIN_SENTENCES) -> DataFrame:
    """Add ``f_ijz`` to a pool: smoothed log ratio of a type's mass to that of the other types.

    The smoothing grows for cells with few sentences, at most elevenfold. The
    pool is small (roles x causes x types), its totals are a window.
    """
    w = Window.partitionBy("role", "risk_bucket")
    other = F.greatest(F.sum("sum_s").over(w) - F.col("sum_s"), F.lit(0.0))
    a = alpha * (1 + F.least(least / F.when(F.col("n_sent") == 0, 1).otherwise(F.col("n_sent")), F.lit(10.0)))
    return pooled.withColumn("f_ijz", F.ln((F.col("sum_s") + a) / (other + a)))


def prior_features(share: DataFrame, fijz: DataFrame, company: str, tau: float = fixed.TAU) -> DataFrame:
    """``company, prior_z1..3``: shares weighted by the prior, its weight growing with the sentences behind it."""
    w = F.log1p(F.greatest("n_sent", F.lit(1)))
    weight = fijz.withColumn("w", w).withColumn("weight", F.col("f_ijz") / tau * F.col("w") / (F.max("w").over(Window.partitionBy("z_label")) + 1e-6))
    # roles x causes x types: bounded by the role list, not by the data
    wide = weight.groupBy("role", "risk_bucket").agg(*[F.sum(F.when(F.col("z_label") == z, F.col("weight"))).alias(f"w{z}") for z in (1, 2, 3)])
    return share.join(F.broadcast(wide), ["role", "risk_bucket"], "left").groupBy(company).agg(*[F.sum(F.col("a_mij") * F.coalesce(f"w{z}", F.lit(0.0))).alias(f"prior_z{z}") for z in (1, 2, 3)])


def pivot_features(share: DataFrame, company: str, pairs: list[str]) -> DataFrame:
    """One column per ``role|cause`` of the given list, 0 where a company has none."""
    keyed = share.withColumn("pair", F.concat_ws("|", "role", "risk_bucket"))
    return keyed.groupBy(company).pivot("pair", pairs).agg(F.sum("a_mij")).fillna(0.0)


def scale(features: DataFrame, columns: list[str]) -> DataFrame:
    """Columns over their population deviation, not centred; a constant column stays."""
    stats = features.agg(*[F.stddev_pop(c).alias(f"__{k}") for k, c in enumerate(columns)])
    joined = features.crossJoin(F.broadcast(stats))  # one row
    keep = [c for c in features.columns if c not in columns]
    return joined.select(*keep, *[(F.col(f"`{c}`") / F.when(F.col(f"__{k}") == 0, 1.0).otherwise(F.col(f"__{k}"))).alias(c) for k, c in enumerate(columns)])


def hash_order(*columns: str, seed: int = 42) -> Column:
    """Order of a reproducible shuffle: the digest of the key and a seed."""
    return F.md5(F.concat_ws("|", *columns, F.lit(str(seed))))


def stratified_rank(rows: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Add ``rank`` (1-based, in shuffled order) and ``n`` within each label.

    A label may hold a third of all rows, so ranks are made in 64 hash ranges
    of each label and shifted by the counts of the ranges before.
    """
    h = rows.withColumn("__h", hash_order(key, seed=seed)).withColumn("__part", F.conv(F.substring("__h", 1, 2), 16, 10).cast("int"))
    sizes = h.groupBy(label, "__part").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(label).orderBy("__part")
    sizes = sizes.select(label, "__part", F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(label)).alias("n"))
    ranked = h.withColumn("__r", F.row_number().over(Window.partitionBy(label, "__part").orderBy("__h", key)))
    return ranked.join(sizes, [label, "__part"]).withColumn("rank", F.col("__r") + F.col("__before")).drop("__h", "__part", "__r", "__before")


def stratified_split(rows: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``key, label, split``: per label max(1, round-half-even(share n)) rows to validation."""
    ranked = stratified_rank(rows.where(F.col(label).isNotNull()), label, key, seed)
    take = F.greatest(F.lit(1), F.bround(F.col("n") * share, 0))
    return ranked.select(key, label, F.when(F.col("rank") <= take, "validation").otherwise("train").alias("split"))


def stratified_cap(rows: DataFrame, label: str, key: str, cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows of each label, in shuffled order."""
    return stratified_rank(rows, label, key, seed).where(F.col("rank") <= cap).drop("rank", "n")


def quartiles(rows: DataFrame, value: str, key: str) -> DataFrame:
    """Add ``quartile`` 1..4 over the whole table, ties broken by the key, a number.

    The three bounds, each a value and among its rows a key, are found by
    counting; then every row is compared with them. No rank is given to rows,
    so a value that a third of the rows share is no hot key.
    """
    narrow = cut(rows.where(F.col(value).isNotNull()).select(value, key))  # counted several times
    total = narrow.agg(F.count("*").alias("n"))
    # as ntile: the first n mod 4 quartiles hold one row more
    starts = total.select(F.explode(F.array(*[F.struct(F.lit(t).alias("t"), (F.lit(t) * F.floor(F.col("n") / 4) + F.least(F.lit(t), F.col("n") % 4)).alias("rank")) for t in (1, 2, 3)])).alias("s")).select("s.t", "s.rank")
    at = starts.select("rank").distinct()
    bound = at_ranks(narrow, at, value).collect()  # at most three rows
    keys = None
    for r in bound:
        one = narrow.where(F.col(value) == F.lit(r[value]))
        k = at_ranks(one, rows.sparkSession.createDataFrame([(r["into"],)], "rank bigint"), key).select(F.lit(r["rank"]).alias("rank"), F.lit(r[value]).alias("__v"), F.col(key).alias("__k"))
        keys = k if keys is None else keys.union(k)
    if keys is None:
        return rows.withColumn("quartile", F.lit(1))
    bounds = starts.join(keys, "rank").agg(F.collect_list(F.struct(F.col("__v").alias("v"), F.col("__k").alias("k"))).alias("__bounds"))
    reached = F.filter("__bounds", lambda b: (F.col(value) > b["v"]) | ((F.col(value) == b["v"]) & (F.col(key) >= b["k"])))
    return rows.crossJoin(F.broadcast(bounds)).withColumn("quartile", (F.size(reached) + 1).cast("int")).drop("__bounds")


def fallback_labels(rows: DataFrame, distance: str, text: str, key: str) -> DataFrame:
    """Add ``risk_bucket``: quartiles of the distance, if that has one value only quartiles of the text length, else halves by it.

    Missing distances count 1. Two one-row facts decide which of the three holds.
    """
    filled = rows.withColumn("__d", F.coalesce(F.col(distance).cast("double"), F.lit(1.0))).withColumn("__l", F.coalesce(F.length(text), F.lit(0)).cast("double"))
    spread = filled.agg((F.min("__d") < F.max("__d")).alias("d"), (F.min("__l") < F.max("__l")).alias("l")).first()
    if spread["d"] or spread["l"]:
        by, name = ("__d", "risk_q") if spread["d"] else ("__l", "len_q")
        out = quartiles(filled, by, key).withColumn("risk_bucket", F.concat(F.lit(name), F.col("quartile").cast("string"))).drop("quartile")
    else:
        out = filled.withColumn("risk_bucket", F.lit("bin_a"))
    return out.drop("__d", "__l")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """``label, n, weight``: total / (classes x n)."""
    n = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy()  # one row per class
    return n.select(label, "n", (F.sum("n").over(w) / (F.count("*").over(w) * F.col("n"))).alias("weight"))


def self_check(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``n_left, n_right, n_both, n_any``: distinct keys of two tables, counted in one aggregation."""
    sides = left.select(F.col(key), F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(F.col(key), F.lit(0), F.lit(1))).where(F.col(key).isNotNull())
    per = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("n_left"), F.coalesce(F.sum("r"), F.lit(0)).alias("n_right"), F.count_if((F.col("l") + F.col("r")) == 2).alias("n_both"), F.count("*").alias("n_any"))


def counts_by_type(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Distinct keys by label with the total as the null label (A37): one scan by rollup."""
    return rows.where(F.col(label).isNotNull()).rollup(label).agg(F.countDistinct(key).alias("n"))
