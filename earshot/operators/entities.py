"""Company names as the outcome tables match them: three levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions import fixed
from earshot.operators.skew import salted_lookup, spread_join
from earshot.session import cut


def normal_name(name: Column) -> Column:
    """Upper case, letters and digits, two phrases shortened."""
    s = F.upper(F.regexp_replace(F.coalesce(name, F.lit("")), fixed.NAME_MARKS, ""))
    s = F.trim(F.regexp_replace(s, "[^A-Z0-9]+", " "))
    for pattern, short in fixed.NAME_PHRASES:
        s = F.regexp_replace(s, pattern, short)
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def stems(normal: Column) -> Column:
    """Tokens without legal and noise words, abbreviations spelled out, cut to six characters."""
    tokens = F.filter(F.split(normal, " "), lambda t: F.length(t) > 1)

    canonical = F.create_map(*[F.lit(x) for pair in fixed.CANONICAL_TOKENS.items() for x in pair])
    kept = F.filter(F.transform(tokens, lambda t: F.coalesce(canonical[t], t)), lambda t: ~t.isin(fixed.LEGAL_TOKENS + fixed.NOISE_TOKENS))
    return F.transform(kept, lambda t: F.substring(t, 1, 6))


def named(rows: DataFrame, name: str) -> DataFrame:
    """``name, norm, key, sorted_key, stem_set`` of the distinct names."""
    s = rows.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct().withColumn("norm", normal_name(F.col("name")))
    s = s.withColumn("stems", stems(F.col("norm"))).withColumn("stem_set", F.array_sort(F.array_distinct("stems")))
    return s.select("name", "norm", F.array_join("stems", " ").alias("key"), F.array_join("stem_set", " ").alias("sorted_key"), "stem_set")


def prefixes(named_rows: DataFrame, counts: DataFrame, name: str, least: float) -> DataFrame:
    """``name, stem, set`` of the first ``n - ceil(least n) + 1`` stems of each name's n, the rarest first.

    Two sets of Jaccard similarity ``least`` or more share a stem of these
    prefixes, whichever way all stems are ordered.
    """
    each = named_rows.select(F.col("name"), F.explode("stem_set").alias("stem"))
    ranked = salted_lookup(each, counts, ["stem"]).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "stem"))).alias("s"))
    take = (F.size("s") - F.ceil(F.size("s") * F.lit(least) - 1e-9) + 1).cast("int")
    return ranked.select(F.col("name").alias(name), F.explode(F.slice("s", F.lit(1), take)["stem"]).alias("stem"), F.array_sort(F.col("s")["stem"]).alias(f"{name}_set"))


def match_levels(left: DataFrame, right: DataFrame, least: float = 0.6) -> DataFrame:
    """``name, level, matched, score``: by normal name, then by sorted stems, then by Jaccard similarity of the stems.

    Each level sees only what the ones before left. Several right names of one
    key give the smallest. The third level finds the most similar of all right
    names, the smallest of ties, by a prefix filter: names meet on their rare
    stems and every meeting is verified; no pair at or over ``least`` is lost.
    """
    one = right.where("norm <> ''").groupBy("norm").agg(F.min("name").alias("matched"))
    exact = left.join(one, "norm").select("name", F.lit(1).alias("level"), "matched", F.lit(1.0).alias("score"))
    rest = left.join(exact.select("name"), "name", "left_anti")
    two = right.where("sorted_key <> ''").groupBy("sorted_key").agg(F.min("name").alias("matched"))
    by_key = rest.join(two, "sorted_key").select("name", F.lit(2).alias("level"), "matched", F.lit(1.0).alias("score"))
    rest = rest.join(by_key.select("name"), "name", "left_anti").where(F.size("stem_set") > 0).select("name", "stem_set")
    rest = cut(rest)
    other = right.where(F.size("stem_set") > 0).select("name", "stem_set")
    counts = rest.union(other).select(F.explode("stem_set").alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))
    near = spread_join(prefixes(other, counts, "matched", least), prefixes(rest, counts, "name", least), "stem", "matched")
    similarity = F.size(F.array_intersect("name_set", "matched_set")) / F.size(F.array_union("name_set", "matched_set"))
    near = near.withColumn("score", similarity).where(F.col("score") >= least)
    best = near.groupBy("name").agg(F.min_by(F.struct("matched", "score"), F.struct(-F.col("score"), F.col("matched"))).alias("m"))
    return exact.union(by_key).union(best.select("name", F.lit(3), "m.matched", "m.score"))


def earliest_events(rows: DataFrame, name: str, date: str) -> DataFrame:
    """``norm, event_date``: the earliest known date of each normal name (A33); null if none is known."""
    return rows.withColumn("norm", normal_name(F.col(name))).where("norm <> ''").groupBy("norm").agg(F.min(date).alias("event_date"))
