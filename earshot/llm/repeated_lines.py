"""Lines repeated across one source's documents (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.operators.skew import salted_lookup


def letters_only(text: Column) -> Column:
    """Lower case with only letters kept."""
    return F.regexp_replace(F.lower(text), r"\P{L}+", "")


def _fingerprint(text: Column) -> tuple[Column, Column]:
    """96 bits of the normalised line: two unlike hashes instead of the line itself travel through the shuffles."""
    norm = letters_only(text)
    return F.xxhash64(norm).alias("__h1"), F.hash(norm).alias("__h2")


def frequent_lines(lines: DataFrame, source: str, document: str, text: str, min_documents: int = 4, min_share: float = 0.25) -> DataFrame:
    """``source, __h1, __h2, n_documents, n_source`` of the lines in at least ``min_documents`` and ``min_share`` of a source's documents.

    Both counts are distinct counts with a map-side combine, so a source with a
    third of all rows is spread by (source, line, document).
    """
    h1, h2 = _fingerprint(F.col(text))
    named = lines.where(F.col(source).isNotNull() & F.col(document).isNotNull())
    seen = named.where(letters_only(F.col(text)) != "").select(F.col(source).alias("__source"), h1, h2, F.col(document).alias("__doc")).distinct()
    per_line = seen.groupBy("__source", "__h1", "__h2").agg(F.count("*").alias("n_documents")).where(F.col("n_documents") >= min_documents)
    per_source = named.select(F.col(source).alias("__source"), F.col(document).alias("__doc")).distinct().groupBy("__source").agg(F.count("*").alias("n_source"))
    return salted_lookup(per_line, per_source, ["__source"]).where(F.col("n_documents") >= F.col("n_source") * min_share)


def repeated_lines(lines: DataFrame, source: str = "company", document: str = "call_id", position: str = "sentence_id", text: str = "sentence_text", min_documents: int = 4, min_share: float = 0.25) -> DataFrame:
    """``document, position`` of every line to remove, each once.

    The source is taken exactly as written; lines are the same if equal in
    lower case with only letters kept. Rows with a null source, document or
    text and lines without a letter are never repeated lines; repeated rows
    count once; an empty table gives no row. Further columns are not read.
    """
    frequent = frequent_lines(lines, source, document, text, min_documents, min_share).select("__source", "__h1", "__h2")
    h1, h2 = _fingerprint(F.col(text))
    at = lines.where(F.col(source).isNotNull() & F.col(document).isNotNull() & (letters_only(F.col(text)) != "")).select(F.col(source).alias("__source"), h1, h2, F.col(document).alias(document), F.col(position).alias(position))
    return salted_lookup(at.distinct(), frequent, ["__source", "__h1", "__h2"]).select(document, position).distinct()


def without_repeated_lines(lines: DataFrame, source: str = "company", document: str = "call_id", position: str = "sentence_id", text: str = "sentence_text", min_documents: int = 4, min_share: float = 0.25) -> DataFrame:
    """``document, n_lines, n_removed, text``: each document rebuilt in order without its repeated lines.

    A position delivered more than once stands once (the smallest text). A
    document all of whose lines are removed keeps a row with an empty text.
    Documents of a null source lose nothing. Null texts are left out.
    """
    gone = repeated_lines(lines, source, document, position, text, min_documents, min_share).withColumn("__gone", F.lit(True))
    one = lines.where(F.col(document).isNotNull()).groupBy(F.col(document).alias(document), F.col(position).alias(position)).agg(F.min(text).alias("__text"))
    joined = one.join(gone, [document, position], "left")
    kept = F.when(F.col("__gone").isNull() & F.col("__text").isNotNull(), F.struct(F.col(position).alias("p"), F.col("__text").alias("t")))
    whole = joined.groupBy(document).agg(F.count("*").alias("n_lines"), F.count("__gone").alias("n_removed"), F.array_sort(F.collect_list(kept)).alias("k"))
    return whole.select(document, "n_lines", "n_removed", F.array_join(F.col("k.t"), "\n").alias("text"))
