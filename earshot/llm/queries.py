"""The queries of the nine training-data problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import leaks, names, repeated_lines, sentences, splits, terms, tokens, toxicity, turns
from earshot.session import cut
from earshot.sources.tables import table


def _records(spark: SparkSession, d: str) -> DataFrame:
    cols = ("rec_no", "company_id", "issuer_no")
    return table(spark, d, "labels_y", *cols).unionByName(table(spark, d, "preds_val_ens", *cols))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.linked_groups(_records(spark, d)).where("shared").select("rec_no", "group_no")


def p1_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.grouped_split(splits.linked_groups(_records(spark, d)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "call_blocks", "block_id", "sentence_text")).select("block_id", "start_pos", "end_pos")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, d, "term_occ", "company", "call_id", "sentence_id", "sentence_text"))


def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(table(spark, d, "term_occ", "company", "call_id", "sentence_id", "sentence_text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequency(table(spark, d, "term_occ", "term", "rec_id", "call_id")).select("term", "n_occ", "n_calls", "mark")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return turns.speaker_turns(table(spark, d, "call_lines", "call_id", "sentence_id", "line_id", "speaker", "sentence_text"))


def _organisations(spark: SparkSession, d: str) -> DataFrame:
    typed = table(spark, d, "term_occ", "company").select(F.col("company").alias("name")).union(table(spark, d, "bankrupt_all", "conm"))
    return names.organisations(typed)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return names.spelling_pairs(_organisations(spark, d))


def p6_organisations(spark: SparkSession, d: str) -> DataFrame:
    """Membership: the organisation of every spelling."""
    return _organisations(spark, d)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents", "doc_id", "text"))


def _matches(spark: SparkSession, d: str, positions: bool = False) -> DataFrame:
    return leaks.window_matches(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"), positions=positions)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(_matches(spark, d))


def p8_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    return leaks.reparameterised(_matches(spark, d, positions=True).transform(cut))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.score_documents(table(spark, d, "documents", "doc_id", "text", "source"), table(spark, d, "content_labels", "doc_id", "unfit"), keep=["source"])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("unfit").select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.rates(_scored(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_split, p2_found, p3_found, p3_cleaned, p4_found, p5_found, p6_found, p6_organisations, p7_ids, p8_found, p8_reparameterised, p9_found, p9_rates)}


def oracle_sql() -> dict[str, str]:
    lines = r"""
WITH l AS (SELECT DISTINCT company, call_id, sentence_id, regexp_replace(lower(sentence_text), '[^\p{L}]', '', 'g') AS k
           FROM term_occ WHERE company IS NOT NULL AND call_id IS NOT NULL),
     s AS (SELECT company, count(DISTINCT call_id) AS n FROM l GROUP BY company),
     f AS (SELECT l.company, l.k FROM l JOIN s USING (company) WHERE k <> '' GROUP BY l.company, l.k, s.n
           HAVING count(DISTINCT call_id) >= 4 AND count(DISTINCT call_id) >= 0.25 * s.n),
     gone AS (SELECT DISTINCT l.call_id, l.sentence_id FROM l JOIN f USING (company, k))"""
    cleaned = """,
     one AS (SELECT call_id, sentence_id, min(sentence_text) AS t FROM term_occ WHERE call_id IS NOT NULL GROUP BY call_id, sentence_id)
SELECT o.call_id, count(*) AS n_lines, count(g.call_id) AS n_removed, coalesce(string_agg(t, chr(10) ORDER BY o.sentence_id) FILTER (g.call_id IS NULL), '') AS text
FROM one o LEFT JOIN gone g ON o.call_id = g.call_id AND o.sentence_id = g.sentence_id GROUP BY o.call_id"""
    groups = r"""
WITH RECURSIVE raw AS (SELECT rec_no, company_id, issuer_no FROM labels_y UNION ALL SELECT rec_no, company_id, issuer_no FROM preds_val_ens),
     r AS (SELECT rec_no, nullif(regexp_replace(lower(split_part(company_id, ',', 1)), '[^\p{L}\p{N}]+', '', 'g'), '') AS c, regexp_replace(regexp_extract(issuer_no, '\d+'), '^0+', '') AS i FROM raw WHERE rec_no IS NOT NULL),
     k AS (SELECT DISTINCT rec_no, 'c' || c AS key FROM r WHERE c IS NOT NULL UNION SELECT rec_no, 'i' || i FROM r WHERE i <> '' AND NOT regexp_full_match(i, '9+')),
     e AS (SELECT DISTINCT a.rec_no AS u, b.rec_no AS v FROM k a JOIN (SELECT key, min(rec_no) AS rec_no FROM k GROUP BY key) b USING (key)),
     both_ways AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
     walk AS (SELECT DISTINCT u, u AS m FROM both_ways UNION SELECT b.v, w.m FROM walk w JOIN both_ways b ON b.u = w.u),
     g AS (SELECT u AS rec_no, min(m) AS group_no FROM walk GROUP BY u)
SELECT rec_no, group_no FROM g WHERE group_no IN (SELECT group_no FROM g GROUP BY group_no HAVING count(*) > 1)"""
    return {"p1_found": groups, "p3_found": lines + " SELECT call_id, sentence_id FROM gone", "p3_cleaned": lines + cleaned}
