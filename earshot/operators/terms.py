"""Term mining: term x document counts, profiles, filters and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions import fixed
from earshot.functions.text import contains_any, content_gram, english_tokens, ngrams
from earshot.operators.skew import salted_lookup


def document_counts(rows: DataFrame, term: str, document: str) -> DataFrame:
    """``term, doc_id, n`` (A2)."""
    return rows.groupBy(F.col(term).alias("term"), F.col(document).alias("doc_id")).agg(F.count("*").alias("n"))


def has_finance_stem(words: Column) -> Column:
    """Whether any word holds a stem of finance."""
    return contains_any(F.array_join(words, " "), fixed.FINANCE_STEMS)


def potential_anchor(word: Column) -> Column:
    """Whether a word may anchor a financial phrase: three letters or more, a stem of finance, no stopword, time or unit."""
    return (F.length(word) >= 3) & ~word.isin(fixed.STOPWORDS + fixed.TIME_WORDS + fixed.UNIT_WORDS) & contains_any(word, fixed.FINANCE_STEMS)


def anchor_words(core: DataFrame, lexicon: DataFrame, manual: list[str] = fixed.ANCHOR_WORDS) -> DataFrame:
    """``token``: anchors out of the core tokens, the words of the financial lexicon's terms and a list."""
    listed = core.sparkSession.createDataFrame([(w,) for w in sorted(set(manual))], "token string")
    words = core.select("token").union(lexicon.select(F.explode(F.split("term", " ")).alias("token"))).union(listed)
    return words.where(potential_anchor(F.col("token"))).distinct()


def anchored_terms(rows: DataFrame, text: str, anchors: DataFrame, sizes: tuple[int, ...] = (1, 2, 3), least_ratio: float = fixed.MIN_ANCHOR_RATIO) -> DataFrame:
    """``term, freq``: content of the n-grams that stand for something financial.

    A gram counts if it holds more than stopwords, is not only times, only
    units or only comparisons, and of its words that are no stopwords at least
    one, and at least the share ``least_ratio``, are anchors. Stopwords and
    units are then left out. Whether a gram counts depends on its words only,
    so grams are counted first and judged once each.
    """
    tokens = rows.select(english_tokens(F.col(text)).alias("t"))
    grams = tokens.select(F.explode(F.concat(*[ngrams(F.col("t"), n) for n in sizes])).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    plain = F.filter(F.split("gram", " "), lambda w: ~w.isin(fixed.STOPWORDS))
    every = lambda words: F.forall("plain", lambda w: w.isin(words))
    judged = grams.withColumn("plain", plain).where(F.size("plain") > 0).where(~every(fixed.TIME_WORDS) & ~every(fixed.UNIT_WORDS) & ~every(fixed.COMPARISON_WORDS))
    words = judged.select("gram", "n", F.size("plain").alias("size"), F.explode("plain").alias("token"))
    hits = salted_lookup(words, anchors.select("token"), ["token"]).groupBy("gram").agg(F.count("*").alias("hits"), F.first("size").alias("size"), F.first("n").alias("n"))
    kept = hits.where(F.col("hits") >= F.col("size") * least_ratio)
    return kept.select(content_gram(F.col("gram")).alias("term"), "n").where("term <> ''").groupBy("term").agg(F.sum("n").alias("freq"))


def usable_word(word: Column) -> Column:
    """Whether a lexicon entry is one word of two letters or more, hyphens and apostrophes aside."""
    return (F.length(word) > 1) & F.regexp_replace(word, "[-']", "").rlike(r"^\p{L}+$")


def corpus_tokens(rows: DataFrame, text: str) -> DataFrame:
    """``n_texts, n_tokens`` of a corpus."""
    return rows.agg(F.count(text).alias("n_texts"), F.coalesce(F.sum(F.size(english_tokens(F.col(text)))), F.lit(0)).cast("bigint").alias("n_tokens"))


def boring(term: Column, in_lexicon: Column) -> Column:
    """Phrases without financial meaning (F9); terms of the financial lexicon are boring only if nothing but stopwords and units is left."""
    words = F.split(term, " ")
    content = F.filter(words, lambda w: ~w.isin(fixed.STOPWORDS + fixed.UNIT_WORDS))
    every = lambda ws: F.forall(content, lambda w: w.isin(ws))
    outside = ~has_finance_stem(content) | F.get(words, F.lit(0)).isin(fixed.BORING_STARTS) | every(fixed.TIME_WORDS) | every(fixed.COMPARISON_WORDS + fixed.STOPWORDS)
    return (F.size(content) == 0) | ((in_lexicon == 0) & outside)


def features(counts: DataFrame, membership: DataFrame, core: DataFrame, risk_membership: DataFrame, risk_core: DataFrame) -> DataFrame:
    """``term, freq_total, n_docs, doc_entropy, doc_entropy_weighted, in_lexicon, core_hits, in_risk, risk_hits`` (A3, A4).

    ``doc_entropy`` counts each document once, so it is ln(documents) up to the
    1e-12 inside the logarithm (T5); ``doc_entropy_weighted`` uses the counts.
    Both come from one aggregation: entropy = ln(F) - sum(n ln n) / F.
    """
    n = F.col("n")
    agg = counts.groupBy("term").agg(F.sum(n).alias("freq_total"), F.count("*").alias("n_docs"), F.sum(n * F.ln(n)).alias("nlogn"))
    agg = agg.select("term", "freq_total", "n_docs", (-F.ln(1 / F.col("n_docs") + 1e-12)).alias("doc_entropy"), (F.ln("freq_total") - F.col("nlogn") / F.col("freq_total")).alias("doc_entropy_weighted"))
    marks = core.select("token", F.lit(1).alias("c"), F.lit(0).alias("r")).union(risk_core.select("token", F.lit(0), F.lit(1)))
    words = agg.select("term", F.explode(F.array_distinct(F.split("term", " "))).alias("token"))
    hits = words.join(marks, "token").groupBy("term").agg(F.sum("c").alias("core_hits"), F.sum("r").alias("risk_hits"))
    out = agg.join(membership, "term", "left").join(risk_membership.select("term", F.lit(1).alias("in_risk")).distinct(), "term", "left").join(hits, "term", "left")
    return out.fillna(0, ["in_lexicon", "core_hits", "in_risk", "risk_hits"])


def filter_and_score(feats: DataFrame, least_freq: int = 30, least_docs: int = 5, weights: dict[str, float] | None = None) -> DataFrame:
    """``term, score`` of the terms that pass the filters; if none passes, of all.

    Terms of the risk lexicon and terms with a core token of risk do not pass.

    Features are scaled between their extremes over the kept terms, constant
    ones to 0; the extremes are one row, joined by broadcast.
    """
    weights = weights or fixed.TERM_WEIGHTS
    not_risk = (F.col("in_risk") == 0) & (F.col("risk_hits") == 0)
    keep = not_risk & (F.col("freq_total") >= least_freq) & (F.col("n_docs") >= least_docs) & ((F.col("core_hits") > 0) | (F.col("in_lexicon") == 1)) & ~boring(F.col("term"), F.col("in_lexicon"))
    flagged = feats.withColumn("keep", keep.cast("int"))
    anything = flagged.agg(F.max("keep").alias("any_kept"))
    kept = flagged.crossJoin(F.broadcast(anything)).where("keep = 1 or any_kept = 0")
    x = {"freq": F.log1p("freq_total"), "docs": F.log1p("n_docs"), "entropy": F.col("doc_entropy"), "core": F.col("core_hits").cast("double"), "financial": F.col("in_lexicon").cast("double"), "not_risk": not_risk.cast("double")}
    rows = kept.select("term", *[x[k].alias(k) for k in weights])
    scaled = [k for k in weights if k not in ("financial", "not_risk")]
    span = rows.agg(*[F.min(k).alias(f"lo_{k}") for k in scaled], *[F.max(k).alias(f"hi_{k}") for k in scaled])
    one = rows.crossJoin(F.broadcast(span))
    value = {k: F.coalesce(F.try_divide(F.col(k) - F.col(f"lo_{k}"), F.col(f"hi_{k}") - F.col(f"lo_{k}")), F.lit(0.0)) if k in scaled else F.col(k) for k in weights}
    return one.select("term", sum((w * value[k] for k, w in weights.items()), F.lit(0.0)).alias("score"))
