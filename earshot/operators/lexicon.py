"""Lexicons: n-gram counts, flag tables, merging, core tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.functions.text import letter_tokens, ngrams, only_stopwords


def all_ngrams(rows: DataFrame, text: str, sizes: tuple[int, ...]) -> DataFrame:
    """``n, term`` of every n-gram of the texts, one scan for all sizes."""
    tokens = rows.select(letter_tokens(F.col(text)).alias("t"))
    grams = F.array(*[F.struct(F.lit(n).alias("n"), ngrams(F.col("t"), n).alias("g")) for n in sizes])
    return tokens.select(F.explode(grams).alias("x")).select(F.col("x.n").alias("n"), F.explode("x.g").alias("term"))


def ngram_counts(rows: DataFrame, text: str, least: dict[int, int], drop_stopwords: bool = False) -> DataFrame:
    """``n, term, freq`` of the n-grams at or above the least frequency of their size."""
    grams = all_ngrams(rows, text, tuple(least))
    if drop_stopwords:
        grams = grams.where(~only_stopwords(F.col("term")))
    enough = reduce(lambda c, kv: c.when(F.col("n") == kv[0], F.lit(kv[1])), least.items(), F)
    return grams.groupBy("n", "term").agg(F.count("*").alias("freq")).where(F.col("freq") >= enough)


def unpivot_flags(wide: DataFrame, columns: list[str], prefix: str, rest: str) -> DataFrame:
    """``bucket, term``: one row per positive flag; terms without any go to ``rest``."""
    flags = F.filter(F.array(*[F.when(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) > 0, F.lit(prefix + c)) for c in columns]), lambda b: b.isNotNull())
    return wide.select(F.explode(F.when(F.size(flags) > 0, flags).otherwise(F.array(F.lit(rest)))).alias("bucket"), "term")


def merge(parts: list[DataFrame]) -> DataFrame:
    """``bucket, terms``: the sorted set of terms of each bucket over all parts."""
    every = reduce(lambda a, b: a.unionByName(b), [p.select("bucket", "term") for p in parts])
    return every.distinct().groupBy("bucket").agg(F.array_sort(F.collect_list("term")).alias("terms"))


def core_tokens(financial: DataFrame, risk: DataFrame, least: int = 5, ratio: float = 2.0) -> DataFrame:
    """``token, n_financial, n_risk, core``: tokens that mark one lexicon clearly (A5).

    Both lexicons are counted in one aggregation, so there is no outer join.
    """
    sides = financial.select("term", F.lit(1).alias("f"), F.lit(0).alias("r")).union(risk.select("term", F.lit(0), F.lit(1)))
    tokens = sides.select(F.explode(F.array_distinct(F.split("term", " "))).alias("token"), "f", "r").where(F.length("token") >= 3)
    n = tokens.groupBy("token").agg(F.sum("f").alias("n_financial"), F.sum("r").alias("n_risk"))
    is_f = (F.col("n_financial") >= least) & (F.col("n_financial") >= ratio * F.greatest("n_risk", F.lit(1)))
    is_r = (F.col("n_risk") >= least) & (F.col("n_risk") >= ratio * F.greatest("n_financial", F.lit(1)))
    return n.where(is_f | is_r).withColumn("core", F.when(is_f, "financial").otherwise("risk"))


def membership(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``term, in_lexicon, categories`` of each term."""
    listed = lexicon.groupBy("term").agg(F.array_join(F.array_sort(F.collect_set("bucket")), ";").alias("categories"))
    return terms.join(listed, "term", "left").select("term", F.col("categories").isNotNull().cast("int").alias("in_lexicon"), F.coalesce("categories", F.lit("")).alias("categories"))


def labelled_phrases(lines: DataFrame) -> DataFrame:
    """``phrase, label`` of lines ``phrase@label``, cut at the last @."""
    pattern = r"(?s)^(.*)@([^@]*)$"
    return lines.where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("phrase"), F.regexp_extract("value", pattern, 2).alias("label"))


def json_entries(rows: DataFrame, column: str) -> DataFrame:
    """``key, value`` of every entry of JSON maps."""
    return rows.select(F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))
