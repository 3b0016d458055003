"""Delimited files with unsure encodings, separators and column names."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions.roles import normal_role
from earshot.functions.text import canonical_risk, parse_date

#: Names under which a column may come, in order of preference.
ALIASES = {
    "text": ["text", "sentence", "sentence_text", "content"],
    "sent_idx": ["sent_idx", "sentence_id", "idx", "index"],
    "doc_id": ["doc_id", "document", "file", "filename"],
    "company_id": ["company_id", "company", "firm"],
    "role": ["role", "speaker_role", "speaker"],
    "risk_bucket": ["risk_bucket", "bucket", "risk", "llm_pred_bucket"],
    "a_mij": ["a_mij", "share", "value"],
    "term": ["term", "bigram", "word", "phrase"],
    "category": ["category", "label", "theme", "bucket"],
    "company_name": ["conm", "company_name", "company", "name"],
    "event_date": ["dldte", "date", "bankrupt_date", "event_date"],
}


def clean_names(df: DataFrame) -> DataFrame:
    """Column names without byte-order mark, lower case, spaces as underscores."""
    return df.toDF(*[re.sub(r"\s+", "_", c.lstrip("﻿").strip().lower()) for c in df.columns])


def find_column(columns: list[str], wanted: str, aliases: dict[str, list[str]] | None = None) -> str | None:
    """The first alias that is a column, else the first column that contains an alias."""
    names = (aliases or ALIASES).get(wanted, [wanted])
    lower = {c.lower(): c for c in columns}
    return next((lower[n] for n in names if n in lower), None) or next((c for n in names for c in columns if n in c.lower()), None)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table, or an error that names the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df


def _separator(line: str) -> str:
    return max([",", ";", "\t", "|"], key=lambda s: line.count(s))


ENCODINGS = ("utf-8-sig", "gb18030", "latin-1")
_CELLS = "source_path string, line_no bigint, names array<string>, cells array<string>"


def _records(content: bytes, encodings: tuple[str, ...]) -> tuple[list[str], list[list[str]]] | None:
    """Header and rows of one file in the first encoding that decodes the whole of it; None for an empty file."""
    for encoding in encodings:
        try:
            text = content.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    else:
        text = content.decode(encodings[-1], errors="replace")
    first = next((x for x in text.splitlines() if x.strip()), "")
    if not first:
        return None
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=_separator(first)) if r]
    header = [re.sub(r"\s+", "_", c.lstrip("\ufeff").strip().lower()) for c in rows[0]]
    return header, [r for r in rows[1:] if len(r) == len(header)]


def read_cells(spark: SparkSession, paths: str | list[str], encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """``source_path, line_no, names, cells`` of every row of every file.

    Each file is read by one task and has its own encoding (the first that
    decodes all of it) and separator (the commonest in its header). Rows of
    another length than the header are skipped; an empty file gives no row.
    Names are lower case with underscores, without byte-order mark. No
    file's content comes to the driver, however many there are.
    """
    files = spark.read.format("binaryFile").load(paths).where("length >= 5").select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _records(content, encodings)
                for at in range(0, len(found[1]) if found else 0, 5000):
                    part = found[1][at : at + 5000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array([found[0]] * len(part), pa.list_(pa.string())), pa.array(part, pa.list_(pa.string()))], ["source_path", "line_no", "names", "cells"])

    return files.mapInArrow(run, _CELLS)


def _cell(wanted: str, aliases: dict[str, list[str]] | None = None) -> Column:
    """The cell under the first alias that is a name of the file, else under the first name that contains an alias (F21); blank is null."""
    names = (aliases or ALIASES).get(wanted, [wanted])
    exact = F.coalesce(*[F.nullif(F.array_position("names", a), F.lit(0)) for a in names])
    loose = F.coalesce(*[F.nullif(F.array_position(F.transform("names", lambda c, a=a: F.contains(c, F.lit(a))), True), F.lit(0)) for a in names])
    return F.nullif(F.trim(F.get("cells", (F.coalesce(exact, loose) - 1).cast("int"))), F.lit(""))


def read_all(spark: SparkSession, paths: str | list[str], columns: list[str]) -> DataFrame:
    """Files of different layouts under fixed column names, with ``source_path``; a column that a file lacks is null."""
    return read_cells(spark, paths).select(*[_cell(c).alias(c) for c in columns], "source_path")


def read_delimited(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame | None:
    """The files of one layout as a table of strings under their own names; None if they hold nothing."""
    cells = read_cells(spark, path, encodings)
    first = cells.select("names").first()
    if first is None:
        return None
    at = lambda c: F.get("cells", (F.nullif(F.array_position("names", c), F.lit(0)) - 1).cast("int"))
    return cells.select(*[at(c).alias(c) for c in first["names"]])


def skipped_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path`` of the files that gave no row (K9)."""
    every = spark.read.format("binaryFile").load(paths).select("path")
    return every.join(read_cells(spark, paths).select(F.col("source_path").alias("path")).distinct(), "path", "left_anti")


def load_a_mij(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``company_id, role, risk_bucket, a_mij, source_type``: shares under any of their names, causes and roles made canonical."""
    rows = read_all(spark, paths, ["company_id", "role", "risk_bucket", "a_mij", "source_type"])
    kept = rows.select("company_id", normal_role(F.col("role")).alias("role"), canonical_risk(F.col("risk_bucket")).alias("risk_bucket"), number("a_mij").alias("a_mij"), F.coalesce("source_type", F.nullif(F.regexp_extract("source_path", "(Type_[123])", 1), F.lit(""))).alias("source_type"))
    return kept.where(F.col("company_id").isNotNull() & F.col("risk_bucket").isNotNull())


def load_events(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``conm, event_date``: bankruptcies under any of their column names, dates in four forms (S17, R12); rows without a name go."""
    rows = read_all(spark, paths, ["company_name", "event_date"])
    return rows.where("company_name is not null").select(F.col("company_name").alias("conm"), parse_date(F.col("event_date")).alias("event_date"))


def load_terms(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``company, term, main_role, term_score, time_early, time_late, is_significant`` of recurring-terms tables."""
    names = {"company": ["company"], "term": ["term"], "main_role": ["main_speaker_role", "main_role", "speaker"], "term_score": ["term_score", "score"], "time_early": ["time_early"], "time_late": ["time_late"], "is_significant": ["is_significant", "significant"]}
    cells = read_cells(spark, paths).select(*[_cell(c, names).alias(c) for c in names])
    dates = [parse_date(F.col(c)).alias(c) for c in ("time_early", "time_late")]
    return cells.where("company is not null and term is not null").select("company", "term", F.coalesce("main_role", F.lit("UNKNOWN")).alias("main_role"), number("term_score").alias("term_score"), *dates, truth("is_significant").alias("is_significant"))


#: Artefacts of the stages: name, file pattern below the output folder, loader.
ARTEFACTS = {"a_mij": ("a_mij*.csv", load_a_mij), "events": ("bankrupt*.csv", load_events), "terms": ("*terms*.csv", load_terms)}


def load_artefact(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One artefact by name from an output folder (S15); an unknown name or none of its files raises."""
    if name not in ARTEFACTS:
        raise KeyError(f"unknown artefact {name}; known: {', '.join(ARTEFACTS)}")
    pattern, load = ARTEFACTS[name]
    return load(spark, f"{folder}/{pattern}")


def number(column: str, default: float = 0.0):
    """A tolerant number."""
    return F.coalesce(F.col(column).try_cast("double"), F.lit(default))


def truth(column: str):
    """A tolerant boolean: 1, true, yes, y."""
    return F.coalesce(F.lower(F.trim(F.col(column).cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))
