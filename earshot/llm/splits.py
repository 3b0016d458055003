"""Train, validation and test splits that keep linked records together (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.operators.skew import salted_lookup
from earshot.session import cut


def company_key(name: Column) -> Column:
    """The name up to the first comma, letters and digits only, lower case; null if nothing is left."""
    kept = F.regexp_replace(F.lower(F.substring_index(name, ",", 1)), r"[^\p{L}\p{N}]+", "")
    return F.when(kept != "", kept)


def issuer_key(number: Column) -> Column:
    """The first number in the text without leading zeros; null for no number, zero and all nines."""
    digits = F.regexp_replace(F.regexp_extract(number, r"(\d+)", 1), "^0+", "")
    return F.when((digits != "") & ~digits.rlike("^9+$"), digits)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` of every node of the undirected ``edges(u, v)`` (bigint); root is the least node of the component.

    Alternates large-star (every neighbour above u is tied to the least node
    around u) and small-star (u and its lower neighbours are tied to the least)
    until the edges no longer change, which takes about log(n) rounds. The
    minimum of a neighbourhood is an aggregate with map-side combine and
    reaches the edges by a salted join, so the star of a hot node is spread.
    Each round is cut by a checkpoint. Null ends and loops are dropped,
    repeated edges count once. Raises if it does not converge in
    ``max_rounds``.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = cut(e)
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = salted_lookup(both, low, ["u"], salts=8).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_lookup(large, low, ["u"], salts=8)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
        seen = state
    raise RuntimeError(f"no convergence in {max_rounds} rounds")


def linked_groups(records: DataFrame) -> DataFrame:
    """``rec_no, group_no, n_shared`` of every record of ``records(rec_no, company_id, issuer_no)``.

    Records share an entity if their company keys or their issuer numbers
    agree, on through chains. ``group_no`` is the least ``rec_no`` of the
    group; ``shared`` tells whether another record is in it. Records that have
    no usable key stand alone. Repeated rows count once; rows with a null
    ``rec_no`` are dropped; an empty table gives no row.

    Records are first folded to distinct key pairs, so the graph has one edge
    per pair of company key and issuer, not per record: a hot company or
    issuer costs no more than its distinct partners.
    """
    keyed = records.where("rec_no is not null").select(F.col("rec_no").cast("bigint").alias("rec_no"), company_key(F.col("company_id")).alias("c"), issuer_key(F.col("issuer_no")).alias("i"))
    pairs = cut(keyed.where("c is not null or i is not null").groupBy("c", "i").agg(F.min("rec_no").alias("lo"), F.max("rec_no").alias("hi")))
    c_root = pairs.where("c is not null").groupBy("c").agg(F.min("lo").alias("c_root"))
    i_root = pairs.where("i is not null").groupBy("i").agg(F.min("lo").alias("i_root"))
    both = pairs.where("c is not null and i is not null")
    edges = salted_lookup(salted_lookup(both, c_root, ["c"]), i_root, ["i"]).select(F.col("c_root").alias("u"), F.col("i_root").alias("v"))
    roots = connected_components(edges)
    keys = c_root.select(F.concat(F.lit("c"), "c").alias("key"), F.col("c_root").alias("node")).union(i_root.select(F.concat(F.lit("i"), "i"), "i_root"))
    # a giant group has a great share of the keys: both look-ups are salted
    keys = salted_lookup(keys, roots, ["node"], "left").select("key", F.coalesce("root", "node").alias("group_no"))
    key = F.coalesce(F.concat(F.lit("c"), "c"), F.concat(F.lit("i"), "i")).alias("key")
    # more than one record in the group: its least and greatest record differ
    spans = salted_lookup(pairs.select(key, "lo", "hi"), keys, ["key"]).groupBy("group_no").agg((F.min("lo") < F.max("hi")).alias("shared"))
    keys = salted_lookup(keys, spans, ["group_no"])
    out = salted_lookup(keyed.select("rec_no", key).distinct(), keys, ["key"], "left")
    return out.select("rec_no", F.coalesce("group_no", "rec_no").alias("group_no"), F.coalesce("shared", F.lit(False)).alias("shared"))


def grouped_split(groups: DataFrame, shares: dict[str, float] | None = None, seed: int = 1) -> DataFrame:
    """``rec_no, group_no, split``: the group's hash falls into proportional ranges of [0, 1)."""
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    at = F.pmod(F.xxhash64("group_no", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    total, edge, split = sum(shares.values()), 0.0, None
    for name, share in list(shares.items())[:-1]:
        edge += share / total
        split = split.when(at < edge, name) if split is not None else F.when(at < edge, name)
    last = list(shares)[-1]
    return groups.select("rec_no", "group_no", (split.otherwise(last) if split is not None else F.lit(last)).alias("split"))
