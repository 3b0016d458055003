"""Joins and aggregates that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def salted_lookup(rows: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Join ``rows`` with ``lookup`` (at most one row per key), however the keys of ``rows`` are spread.

    Every lookup row is repeated ``salts`` times and every left row gets one
    salt, so a key with a third of all rows is worked on by ``salts`` tasks.
    Each left row meets one copy only: the result is that of the plain join.
    The salt is a hash of the row itself: a task that is run again after a lost
    executor sends each row where the first run sent it. Null keys match nothing.
    """
    salt = "__salt"
    own = [f.name for f in rows.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    left = rows.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in own]), F.lit(salts)).cast("int"))
    right = lookup.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, salt], how).drop(salt)


def two_level(rows: DataFrame, keys: list[str], partial: list[Column], final: list[Column], salt_of: list[str], salts: int = 16) -> DataFrame:
    """Aggregate first by key and salt, then by key: no task sees a whole hot key.

    For aggregates without a map-side combine (``collect_*``, sketches in
    Python) or whose buffers are large. ``final`` reads the columns made by
    ``partial``.
    """
    salt = F.pmod(F.xxhash64(*salt_of), F.lit(salts)).alias("__salt")
    return rows.groupBy(*keys, salt).agg(*partial).groupBy(*keys).agg(*final)


def spread_join(left: DataFrame, right: DataFrame, key: str, spread_by: str, most: int = 2000) -> DataFrame:
    """Inner join of two tables that both repeat their keys; a key with many left rows is worked on by many tasks.

    Keys with more than ``most`` left rows are counted (with a map-side
    combine); their left rows are dealt out by the hash of ``spread_by`` in
    parts of about ``most``, their right rows go to every part. All other rows
    stay single. Null keys match nothing.
    """
    hot = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(key, F.ceil(F.col("__n") / most).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    a = salted_lookup(left, hot, [key], "left").withColumn("__part", F.pmod(F.xxhash64(spread_by), parts).cast("int")).drop("__parts")
    b = salted_lookup(right, hot, [key], "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return a.join(b, [key, "__part"]).drop("__part")


def at_ranks(rows: DataFrame, ranks: DataFrame, value: str, ranges: int = 4096, prefix: str = "") -> DataFrame:
    """``rank, value, into``: the value of each 0-based rank in the order of ``value`` (a number, nulls left out), and how many rows of that value come before the rank.

    Rows are counted in at most ``ranges`` equal ranges between the extremes,
    then by value within the ranges that hold a rank; both counts combine on
    the map side, so no task holds the rows of a range or of a hot value.
    ``ranks`` has few rows (bigint column ``rank``).
    """
    v = F.col(value).cast("double")
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(v))
    span = known.agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    width = F.try_divide(v - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    ranged = known.crossJoin(F.broadcast(span)).withColumn("__range", F.coalesce(F.least(F.floor(width * ranges), F.lit(ranges - 1)), F.lit(0)))
    n = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    above = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # at most ``ranges`` rows
    n = n.select("__range", "__n", F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__before"))
    asked = F.broadcast(ranks).join(n, (F.col("rank") >= F.col("__before")) & (F.col("rank") < F.col("__before") + F.col("__n"))).select("rank", "__range", "__before")
    values = ranged.join(F.broadcast(asked.select("__range", "__before").distinct()), "__range").groupBy("__range", "__before", value).agg(F.count("*").alias("__n"))
    inside = Window.partitionBy("__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("__at", F.col("__before") + F.coalesce(F.sum("__n").over(inside), F.lit(0))).drop("__before")
    hit = values.join(F.broadcast(asked.select("rank", "__range")), "__range").where((F.col("rank") >= F.col("__at")) & (F.col("rank") < F.col("__at") + F.col("__n")))
    return hit.select("rank", F.col(value), (F.col("rank") - F.col("__at")).alias("into"))


def exact_quantile(rows: DataFrame, value: str, q: float) -> DataFrame:
    """One row ``edge``: the q-quantile of a numeric column, linear between its neighbours; null of an empty table."""
    total = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).agg(F.count("*").alias("n"))
    place = total.where("n > 0").select(((F.col("n") - 1) * F.lit(q)).alias("p"))
    ranks = place.select(F.explode(F.array_distinct(F.array(F.floor("p"), F.ceil("p")))).alias("rank"))
    found = at_ranks(rows, ranks, value)
    return found.crossJoin(F.broadcast(place)).agg((F.min(value) + (F.max(value) - F.min(value)) * (F.max("p") - F.floor(F.max("p")))).alias("edge"))
