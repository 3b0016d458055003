"""Phrase matching, proximity and lexical tone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions import fixed
from earshot.functions.text import contains_any, letter_tokens, ngrams, words_in
from earshot.operators.skew import salted_lookup

#: Terms up to which a dictionary is broadcast; a larger one is joined by shuffle.
BROADCAST_TERMS = 100_000


def hit_positions(tokens: Column, phrases: list[str]) -> Column:
    """0-based starts of phrases in a token array, the longest at each start: ``array<struct<i, len>>``.

    The dictionary is a short literal list, tested inside the row: no join.
    ``dictionary_hits`` takes one of any size.
    """
    by_len = sorted({len(p.split()) for p in phrases}, reverse=True)

    def longest(i: Column) -> Column:
        out = F
        for n in by_len:
            same = [p for p in phrases if len(p.split()) == n]
            out = out.when(F.array_join(F.slice(tokens, i + 1, n), " ").isin(same), F.lit(n))
        return out.otherwise(F.lit(0))

    index = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(index, lambda i: F.struct(i.alias("i"), longest(i).alias("len"))), lambda h: h["len"] > 0)


def longest_phrases(rows: DataFrame, phrases: list[str], keys: list[str], tokens: str = "tokens") -> DataFrame:
    """``keys, start_idx, term``: the longest phrase at each token (1-based)."""
    hits = rows.select(*keys, tokens, F.explode(hit_positions(F.col(tokens), phrases)).alias("h"))
    return hits.select(*keys, (F.col("h.i") + 1).cast("int").alias("start_idx"), F.array_join(F.slice(F.col(tokens), F.col("h.i") + 1, F.col("h.len")), " ").alias("term"))


def dictionary_hits(rows: DataFrame, phrases: DataFrame, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """``keys, start_idx, term``: the longest phrase of a dictionary table (``term``) at each token (1-based), however many phrases it has.

    The n-grams of the sizes that occur in the dictionary meet it in a join,
    a broadcast one if the dictionary was counted and is small. Repeated
    phrases count once, null and empty ones not.
    """
    listed = phrases.where(F.col("term") != "").select("term").distinct()
    sizes = sorted(r.n for r in listed.select(F.size(F.split("term", " ")).alias("n")).distinct().collect())
    at = lambda n: F.transform(ngrams(F.col(tokens), n), lambda g, i: F.struct((i + 1).alias("start_idx"), F.lit(n).alias("n"), g.alias("term")))
    none = F.array().cast("array<struct<start_idx: int, n: int, term: string>>")
    grams = rows.select(*keys, F.explode(F.concat(none, *[at(n) for n in sizes])).alias("g")).select(*keys, "g.*")
    hits = _looked_up(grams, listed, "term")
    return hits.groupBy(*keys, "start_idx").agg(F.max_by("term", "n").alias("term"))


def proximity(rows: DataFrame, risk: list[str], supply: list[str], width: int, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """``keys, token_len, near_count, near_ratio``: supply hits with a risk hit within ``width`` tokens."""
    at = lambda p: F.transform(hit_positions(F.col(tokens), p), lambda h: h["i"])
    both = rows.select(*keys, F.size(tokens).alias("token_len"), at(risk).alias("risk"), at(supply).alias("supply"))
    near = F.size(F.filter("supply", lambda s: F.exists("risk", lambda r: F.abs(r - s) <= width)))
    return both.select(*keys, "token_len", near.alias("near_count"), F.round(near / F.greatest("token_len", F.lit(1)), 6).alias("near_ratio"))


def lexical_tone(text: Column) -> dict[str, Column]:
    """Five tone measures of a sentence, 0 for one without words (M1)."""
    tokens, low = letter_tokens(text), F.lower(text)
    n = F.size(tokens) + 1.0
    risk = F.size(F.array_distinct(F.filter(tokens, lambda t: t.isin(fixed.RISK_WORDS)))) + contains_any(low, fixed.RISK_PHRASES).cast("int")
    return {
        "risk": risk / n,
        "sentiment": (words_in(tokens, fixed.POSITIVE_WORDS) - words_in(tokens, fixed.NEGATIVE_WORDS)) / n,
        "uncertainty": words_in(tokens, fixed.UNCERTAINTY_WORDS) / n,
        "hedging": F.when((F.size(tokens) > 0) & contains_any(low, fixed.HEDGING_PHRASES), 1.0).otherwise(0.0),
        "commitment": words_in(tokens, fixed.COMMITMENT_WORDS) / n,
    }


def _looked_up(rows: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """Rows with the entries of their key: a dictionary that was counted and is small is broadcast, a larger one joined with salts, since a word may be hot."""
    small = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    return rows.join(F.broadcast(terms), key) if small else salted_lookup(rows, terms, [key])


#: Signs of a word in any script.
WORD = r"\p{L}\p{M}\p{N}_"
#: How terms with other signs are cut: into Latin runs; without any, into other runs; without any word, into signs.
CUTS = {"latin": "[a-z]+", "script": rf"[{WORD}&&[^a-z]]+", "sign": rf"[^{WORD}\s]"}


def _whole(term: Column) -> Column:
    """Pattern of the term as it stands, not inside a longer word."""
    left = F.when(term.rlike("^[a-z]"), "(^|[^a-z])").when(term.rlike(f"^[{WORD}]"), f"(?<![{WORD}])").otherwise("")
    right = F.when(term.rlike("[a-z]$"), "([^a-z]|$)").when(term.rlike(f"[{WORD}]$"), f"(?![{WORD}])").otherwise("")
    return F.concat(left, F.regexp_replace(term, r"([^a-z0-9 ])", r"\\$1"), right)


def _begun(rows: DataFrame, keep: list[str], runs: Column, listed: DataFrame, most: int) -> DataFrame:
    """``keep`` and the columns of ``listed`` (``first, w``) for each place of ``runs`` from which the runs of ``w`` follow.

    One row a run goes to the join, not one an n-gram: a run meets the entries
    that begin with it, and the runs behind it decide.
    """
    placed = rows.withColumn("__runs", runs).select(*keep, F.explode(F.array_distinct(F.transform("__runs", lambda r, i: F.struct(r.alias("first"), F.concat(F.array_join(F.slice("__runs", i + 1, F.lit(most)), " "), F.lit(" ")).alias("tail"))))).alias("__p"))
    placed = placed.select(*keep, F.col("__p.first").alias("first"), F.col("__p.tail").alias("__tail"))
    return _looked_up(placed, listed, "first").where(F.startswith("__tail", F.concat("w", F.lit(" ")))).drop("__tail", "first")


def term_occurrences(rows: DataFrame, grams: DataFrame, others: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, term``: sentences that hold each term, once a sentence.

    Terms of plain words, however many, are looked up by their first word;
    terms with other signs are cut at those signs and looked up by their first
    run, all their runs having to follow before the whole is tested, so no pair
    of sentence and term is formed without the words of the term.
    """
    tokens = rows.select(*keys, F.lower(text).alias("low"))
    plain = grams.select(F.split_part("term", F.lit(" "), F.lit(1)).alias("first"), F.col("term").alias("w"))
    most = plain.agg(F.max(F.size(F.split("w", " ")))).first()[0]
    found = _begun(tokens, keys, F.regexp_extract_all("low", F.lit(CUTS["latin"]), F.lit(0)), plain, most or 1).select(*keys, F.col("w").alias("term"))
    kind = F.when(F.regexp_like("term", F.lit(CUTS["latin"])), "latin").when(F.regexp_like("term", F.lit(CUTS["script"])), "script").otherwise("sign")
    runs = F.coalesce(*[F.when(kind == k, F.regexp_extract_all("term", F.lit(p), F.lit(0))) for k, p in CUTS.items()])
    cut = others.select("term", kind.alias("kind"), F.size(runs).alias("n"), F.get(runs, 0).alias("first"), F.concat_ws(" ", runs).alias("w"), _whole(F.col("term")).alias("whole"))
    for k, n in sorted((r.kind, r.n) for r in cut.groupBy("kind").agg(F.max("n").alias("n")).collect()):
        held = _begun(tokens, [*keys, "low"], F.regexp_extract_all("low", F.lit(CUTS[k]), F.lit(0)), cut.where(F.col("kind") == k).select("first", "w", "term", "whole"), n)
        found = found.union(held.where(F.regexp_like("low", F.col("whole"))).select(*keys, "term"))
    return found.distinct()  # a term may stand at several places
