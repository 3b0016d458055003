"""Term mining, tone, entity and importance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import fixed
from earshot.operators import entities, importance, lexicon, terms as mining, tone
from earshot.plans.base import RISKS, SQL, TONES, occurrences, sentences, sql_list, terms
from earshot.plans.model_queries import PM, UNITS, probs, units
from earshot.session import cut
from earshot.sources.tables import table

Q, O = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            O[f.__name__] = sql
        return f

    return add


# -- term mining
_COUNTS = SQL + ", tc AS (SELECT term, call_id AS doc_id, count(*) AS n FROM terms GROUP BY ALL)"
_CORE = """, ca AS (SELECT t, count(*) AS f FROM (SELECT unnest(list_distinct(string_split(term, ' '))) AS t FROM (SELECT DISTINCT term FROM terms WHERE prob_risk_legal < 0.2)) WHERE length(t) >= 3 GROUP BY t),
cb AS (SELECT t, count(*) AS r FROM (SELECT unnest(list_distinct(string_split(term, ' '))) AS t FROM (SELECT DISTINCT term FROM terms WHERE prob_risk_legal > 0.5)) WHERE length(t) >= 3 GROUP BY t),
core AS (SELECT ca.t AS token FROM ca LEFT JOIN cb ON ca.t = cb.t WHERE f >= 5 AND f >= 2 * greatest(coalesce(r, 0), 1)), rcore AS (SELECT cb.t AS token FROM cb LEFT JOIN ca ON ca.t = cb.t WHERE r >= 5 AND r >= 2 * greatest(coalesce(f, 0), 1)),
lexi AS (SELECT DISTINCT term, 1 AS in_lexicon FROM terms WHERE NOT contains(term, ' ')), risky AS (SELECT term, 1 AS in_risk FROM terms GROUP BY term HAVING avg(prob_risk_legal) > 0.45)"""
_FEATS = _CORE + """, fe AS (SELECT term, sum(n)::BIGINT AS freq_total, count(*) AS n_docs, -ln(1 / count(*) + 1e-12) AS doc_entropy, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS doc_entropy_weighted FROM tc GROUP BY term),
feats AS (SELECT fe.*, coalesce(in_lexicon, 0) AS in_lexicon, coalesce(in_risk, 0) AS in_risk, len(list_filter(list_distinct(string_split(fe.term, ' ')), lambda w: list_contains(cl, w))) AS core_hits, len(list_filter(list_distinct(string_split(fe.term, ' ')), lambda w: list_contains(rl, w))) AS risk_hits
 FROM fe LEFT JOIN lexi USING (term) LEFT JOIN risky USING (term) CROSS JOIN (SELECT coalesce(list(token), []) AS cl FROM core) CROSS JOIN (SELECT coalesce(list(token), []) AS rl FROM rcore))"""


def _core(spark: SparkSession, d: str, side: str) -> DataFrame:
    t = terms(spark, d)
    return lexicon.core_tokens(t.where("prob_risk_legal < 0.2").select("term").distinct(), t.where("prob_risk_legal > 0.5").select("term").distinct()).where(F.col("core") == side)


def _feats(spark: SparkSession, d: str) -> DataFrame:
    t = terms(spark, d)
    member = t.where(~F.contains("term", F.lit(" "))).select("term").distinct().withColumn("in_lexicon", F.lit(1))
    risky = t.groupBy("term").agg(F.avg("prob_risk_legal").alias("p")).where("p > 0.45").select("term")
    return mining.features(mining.document_counts(t, "term", "call_id"), member, _core(spark, d, "financial"), risky, _core(spark, d, "risk"))


@query(_COUNTS + " SELECT * FROM tc")
def term_doc_counts(spark: SparkSession, d: str) -> DataFrame:
    return mining.document_counts(terms(spark, d), "term", "call_id")


@query(_COUNTS + _FEATS + " SELECT term, freq_total, n_docs, round(doc_entropy, 6) + 0.0 AS doc_entropy, round(doc_entropy_weighted, 6) + 0.0 AS doc_entropy_weighted, in_lexicon, core_hits, in_risk, risk_hits FROM feats")
def term_features(spark: SparkSession, d: str) -> DataFrame:
    return _feats(spark, d).select("term", "freq_total", "n_docs", *[(F.round(c, 6) + 0.0).alias(c) for c in ("doc_entropy", "doc_entropy_weighted")], "in_lexicon", "core_hits", "in_risk", "risk_hits")


_STEM = " OR ".join(f"contains(w, '{s}')" for s in fixed.FINANCE_STEMS if " " not in s)
_BORING = f"""(len(c) = 0 OR (in_lexicon = 0 AND (NOT list_bool_or([{_STEM} FOR w IN c]) OR string_split(term, ' ')[1] IN ({sql_list(fixed.BORING_STARTS)})
 OR list_bool_and([w IN ({sql_list(fixed.TIME_WORDS)}) FOR w IN c]) OR list_bool_and([w IN ({sql_list(fixed.COMPARISON_WORDS + fixed.STOPWORDS)}) FOR w IN c]))))"""


@query(_COUNTS + _FEATS + f""", k AS (SELECT *, (in_risk = 0 AND risk_hits = 0 AND freq_total >= 30 AND n_docs >= 5 AND (core_hits > 0 OR in_lexicon = 1) AND NOT {_BORING}) AS keep FROM (SELECT *, [w FOR w IN string_split(term, ' ') IF w NOT IN ({sql_list(fixed.STOPWORDS + fixed.UNIT_WORDS)})] AS c FROM feats)),
x AS (SELECT term, ln(1 + freq_total) AS a, ln(1 + n_docs) AS b, doc_entropy AS e, core_hits AS h, in_lexicon AS i, CAST(in_risk = 0 AND risk_hits = 0 AS INT) AS nr FROM k WHERE keep OR NOT (SELECT bool_or(keep) FROM k)),
s AS (SELECT min(a) la, max(a) ha, min(b) lb, max(b) hb, min(e) le, max(e) he, min(h) lh, max(h) hh FROM x)
SELECT term, round(0.25 * coalesce((a - la) / nullif(ha - la, 0), 0) + 0.20 * coalesce((b - lb) / nullif(hb - lb, 0), 0) + 0.10 * coalesce((e - le) / nullif(he - le, 0), 0) + 0.20 * coalesce((h - lh) / nullif(hh - lh, 0), 0) + 0.20 * i + 0.05 * nr, 6) AS score FROM x, s""")
def term_filter_score(spark: SparkSession, d: str) -> DataFrame:
    return mining.filter_and_score(_feats(spark, d)).select("term", F.round("score", 6).alias("score"))


_MANUAL = f"SELECT unnest([{sql_list(fixed.ANCHOR_WORDS)}]) AS token"
_ANCHOR = SQL + _CORE + f""", anchors AS (SELECT DISTINCT token FROM (SELECT token FROM core UNION ALL SELECT unnest(string_split(term, ' ')) FROM lexi UNION ALL {_MANUAL}) WHERE length(token) >= 3 AND token NOT IN ({sql_list(fixed.STOPWORDS + fixed.TIME_WORDS + fixed.UNIT_WORDS)}) AND ({_STEM.replace('(w,', '(token,')})),
tok AS (SELECT regexp_extract_all(lower(sentence_text), '[a-z][a-z''-]*') AS t FROM sent),
gr AS (SELECT array_to_string(t[i:i + n - 1], ' ') AS gram, count(*) AS n FROM tok, (SELECT unnest([1, 2, 3]) AS n), LATERAL (SELECT unnest(range(1, len(t) - n + 2)) AS i) GROUP BY 1),
ju AS (SELECT *, [w FOR w IN string_split(gram, ' ') IF w NOT IN ({sql_list(fixed.STOPWORDS)})] AS p FROM gr),
ok AS (SELECT gram, n FROM ju, (SELECT list(token) AS al FROM anchors) WHERE len(p) > 0 AND NOT list_bool_and([w IN ({sql_list(fixed.TIME_WORDS)}) FOR w IN p]) AND NOT list_bool_and([w IN ({sql_list(fixed.UNIT_WORDS)}) FOR w IN p]) AND NOT list_bool_and([w IN ({sql_list(fixed.COMPARISON_WORDS)}) FOR w IN p])
 AND len(list_filter(p, lambda w: list_contains(al, w))) >= greatest(1, len(p) * 0.5))
SELECT term, sum(n)::BIGINT AS freq FROM (SELECT array_to_string([w FOR w IN string_split(gram, ' ') IF w NOT IN ({sql_list(fixed.STOPWORDS + fixed.UNIT_WORDS)})], ' ') AS term, n FROM ok) WHERE term <> '' GROUP BY term"""


@query(_ANCHOR)
def anchored_terms(spark: SparkSession, d: str) -> DataFrame:
    words = terms(spark, d).where(~F.contains("term", F.lit(" "))).select("term").distinct()
    return mining.anchored_terms(sentences(spark, d), "sentence_text", mining.anchor_words(_core(spark, d, "financial"), words))


@query("SELECT count(text) AS n_texts, coalesce(sum(len(regexp_extract_all(lower(text), '[a-z][a-z''-]*'))), 0)::BIGINT AS n_tokens FROM documents")
def corpus_tokens(spark: SparkSession, d: str) -> DataFrame:
    return mining.corpus_tokens(table(spark, d, "documents", "text"), "text")


@query(SQL + r" SELECT DISTINCT term FROM terms WHERE length(term) > 1 AND regexp_full_match(regexp_replace(term, '[-'']', '', 'g'), '\p{L}+')")
def usable_words(spark: SparkSession, d: str) -> DataFrame:
    return terms(spark, d).select("term").distinct().where(mining.usable_word(F.col("term")))


# -- tone
_STAGE = """, st AS (SELECT company, file_date, time_index, CASE WHEN time_index <= e THEN 'early' WHEN time_index <= m THEN 'mid' ELSE 'late' END AS stage FROM (SELECT *, greatest(e + 1, (2 * n) // 3 - 1) AS m FROM (
 SELECT *, greatest(0, n // 3 - 1) AS e FROM (SELECT company, file_date, row_number() OVER (PARTITION BY company ORDER BY file_date) - 1 AS time_index, count(*) OVER (PARTITION BY company) AS n FROM (SELECT DISTINCT company, file_date FROM terms WHERE file_date IS NOT NULL))))),
ts AS (SELECT t.*, stage FROM terms t JOIN st USING (company, file_date))"""
_MEANS = ", ".join(f"avg({m}) AS {m}" for m in TONES)
_WINDOW = _STAGE + f", win AS (SELECT company, term, role, stage, {_MEANS}, count(*) AS n_sentences FROM ts GROUP BY company, term, role, stage HAVING count(*) >= 5)"
_WIDE = ", ".join(f"max({m}) FILTER (stage = '{s}') AS {s}_{m}" for s in ("early", "late") for m in [*TONES, "n_sentences"])
_BOTH = " AND ".join(f"{s}_{m} IS NOT NULL" for s in ("early", "late") for m in TONES)
_SD = ", ".join(f"(SELECT CASE WHEN coalesce(stddev_samp(v), 0) <= 1e-6 THEN 1 ELSE stddev_samp(v) END FROM (SELECT early_{m} AS v FROM both2 UNION ALL SELECT late_{m} FROM both2)) AS s_{m}" for m in TONES)
_SQ = " + ".join(f"pow((late_{m} - early_{m}) / s_{m}, 2)" for m in TONES)
_CAUSE = lambda s: "CASE greatest(" + ", ".join(f"{s}_prob_{r}" for r in RISKS) + ") " + " ".join(f"WHEN {s}_prob_{r} THEN '{r}'" for r in RISKS) + " END"
_SHIFT = _WINDOW + f""", both2 AS (SELECT * FROM (SELECT company, term, role, {_WIDE} FROM win GROUP BY company, term, role) WHERE {_BOTH}), sd AS (SELECT {_SD}),
sh AS (SELECT company, term, role, sqrt({_SQ}) AS d, early_n_sentences AS early_n, late_n_sentences AS late_n, {_CAUSE('early')} AS cause_early, {_CAUSE('late')} AS cause_late FROM both2, sd)"""
_SCORE = _SHIFT + """, pa AS (SELECT company, term, max(d) AS d_max, median(d) AS d_med, count(DISTINCT role) AS speakers_count FROM sh GROUP BY company, term),
pm2 AS (SELECT company, term, role AS main_role, cause_early, cause_late FROM sh QUALIFY row_number() OVER (PARTITION BY company, term ORDER BY d DESC, role) = 1),
pz AS (SELECT *, 0.7 * (d_max - avg(d_max) OVER ()) / CASE WHEN coalesce(stddev_samp(d_max) OVER (), 0) <= 1e-6 THEN 1 ELSE stddev_samp(d_max) OVER () END + 0.3 * (d_med - avg(d_med) OVER ()) / CASE WHEN coalesce(stddev_samp(d_med) OVER (), 0) <= 1e-6 THEN 1 ELSE stddev_samp(d_med) OVER () END AS term_score FROM pa),
cov AS (SELECT company, term, coalesce(sum(n_sentences) FILTER (stage = 'early'), 0)::BIGINT AS early_n_sent, coalesce(sum(n_sentences) FILTER (stage = 'late'), 0)::BIGINT AS late_n_sent FROM win GROUP BY company, term),
kept AS (SELECT * FROM pz JOIN pm2 USING (company, term) JOIN cov USING (company, term) WHERE early_n_sent >= 5 AND late_n_sent >= 5),
sco AS (SELECT *, round(term_score, 9) >= round((SELECT quantile_cont(term_score, 0.8) FROM kept), 9) AS is_significant FROM kept)"""


def _staged(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences with their stage: the relation is deduplicated once, written narrow, and read for the dates and for the rows."""
    return tone.with_stage(cut(terms(spark, d).select("company", "term", "role", "file_date", *TONES)))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return tone.windows(_staged(spark, d), TONES)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    w = cut(_windows(spark, d))  # read twice
    return tone.scores(cut(tone.shifts(w, TONES, RISKS)), w)


@query(SQL + _STAGE + " SELECT company, file_date::VARCHAR AS file_date, CAST(time_index AS INT) AS time_index, stage FROM st")
def company_stage(spark: SparkSession, d: str) -> DataFrame:
    return tone.company_stages(terms(spark, d)).select("company", F.col("file_date").cast("string").alias("file_date"), "time_index", "stage")


@query(SQL + _WINDOW + " SELECT company, term, role, stage, n_sentences, " + ", ".join(f"round({m} + 1e-10, 7) AS {m}" for m in TONES) + " FROM win")
def tone_window(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).select("company", "term", "role", "stage", "n_sentences", *[F.round(F.col(m) + 1e-10, 7).alias(m) for m in TONES])  # means of short decimals: off the tie


@query(SQL + _SHIFT + " SELECT company, term, role, round(d, 6) AS d, early_n, late_n, cause_early, cause_late FROM sh")
def tone_shift(spark: SparkSession, d: str) -> DataFrame:
    return tone.shifts(_windows(spark, d), TONES, RISKS).withColumn("d", F.round("d", 6))


@query(SQL + _SCORE + " SELECT company, term, round(d_max, 6) AS d_max, round(d_med, 6) AS d_med, speakers_count, main_role, cause_early, cause_late, round(term_score, 6) + 0.0 AS term_score, early_n_sent, late_n_sent, is_significant FROM sco")
def term_score_significant(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("company", "term", F.round("d_max", 6).alias("d_max"), F.round("d_med", 6).alias("d_med"), "speakers_count", "main_role", "cause_early", "cause_late", (F.round("term_score", 6) + 0.0).alias("term_score"), "early_n_sent", "late_n_sent", "is_significant")


@query(SQL + _STAGE + " SELECT company, term, stage, file_date::VARCHAR AS peak FROM (SELECT company, term, stage, file_date, count(*) AS n FROM ts GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY company, term, stage ORDER BY n DESC, file_date) = 1")
def peak_dates(spark: SparkSession, d: str) -> DataFrame:
    return tone.peak_dates(_staged(spark, d)).withColumn("peak", F.col("peak").cast("string"))


@query(SQL + " SELECT count(DISTINCT CASE WHEN len(string_split(term, ' ')) = 1 THEN term END) AS n_unigrams, count(DISTINCT CASE WHEN len(string_split(term, ' ')) = 2 THEN term END) AS n_bigrams, count(DISTINCT term) AS n_terms, count(*) AS n_rows FROM terms")
def unique_term_stats(spark: SparkSession, d: str) -> DataFrame:
    size = F.size(F.split("term", " "))
    return terms(spark, d).agg(F.countDistinct(F.when(size == 1, F.col("term"))).alias("n_unigrams"), F.countDistinct(F.when(size == 2, F.col("term"))).alias("n_bigrams"), F.countDistinct("term").alias("n_terms"), F.count("*").alias("n_rows"))


# -- entities
_NORM = lambda c: rf"trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(upper(regexp_replace(coalesce({c}, ''), '\((?:R|r)\)|®|™', '', 'g')), '[^A-Z0-9]+', ' ', 'g')), '\bREAL\s+ESTATE\b', 'RE', 'g'), '\bINVESTMENTS?\b', 'INVS', 'g'), '\s+', ' ', 'g'))"
_CANON = "CASE " + " ".join(f"WHEN t IN ({sql_list([k])}) THEN '{v}'" for k, v in fixed.CANONICAL_TOKENS.items()) + " ELSE t END"
_STEMS = lambda x: f"[t[1:6] FOR t IN [{_CANON} FOR t IN string_split({x}, ' ') IF length(t) > 1] IF t NOT IN ({sql_list(fixed.LEGAL_TOKENS + fixed.NOISE_TOKENS)})]"


def _named_sql(alias: str, source: str) -> str:
    return f"{alias}0 AS (SELECT name, {_NORM('name')} AS norm FROM ({source})), {alias}1 AS (SELECT name, norm, {_STEMS('norm')} AS st FROM {alias}0), {alias} AS (SELECT name, norm, array_to_string(st, ' ') AS key, list_sort(list_distinct(st)) AS ss, array_to_string(list_sort(list_distinct(st)), ' ') AS sorted_key FROM {alias}1)"


_L = _named_sql("l", "SELECT DISTINCT company AS name FROM term_occ WHERE company IS NOT NULL")
_R = _named_sql("r", "SELECT DISTINCT conm AS name FROM bankrupt_all WHERE conm IS NOT NULL")
_MATCH = f"""WITH {_L}, {_R}, e AS (SELECT l.name, 1 AS level, m AS matched, 1.0::DOUBLE AS score FROM l JOIN (SELECT norm, min(name) AS m FROM r WHERE norm <> '' GROUP BY norm) USING (norm)),
k AS (SELECT l.name, 2, m, 1.0::DOUBLE FROM l JOIN (SELECT sorted_key, min(name) AS m FROM r WHERE sorted_key <> '' GROUP BY sorted_key) USING (sorted_key) WHERE l.name NOT IN (SELECT name FROM e)),
j AS (SELECT l.name, 3, r.name AS m, len(list_intersect(l.ss, r.ss)) / len(list_distinct(list_concat(l.ss, r.ss))) AS s FROM l JOIN r ON len(l.ss) > 0 AND len(r.ss) > 0 WHERE l.name NOT IN (SELECT name FROM e) AND l.name NOT IN (SELECT name FROM k) AND s >= 0.6 QUALIFY row_number() OVER (PARTITION BY l.name ORDER BY s DESC, r.name) = 1),
mm AS (SELECT * FROM e UNION ALL SELECT * FROM k UNION ALL SELECT * FROM j)"""


def _matches(spark: SparkSession, d: str) -> DataFrame:
    # distinct names, read by all three levels
    return entities.match_levels(cut(entities.named(table(spark, d, "term_occ", "company"), "company")), cut(entities.named(table(spark, d, "bankrupt_all", "conm"), "conm")))


@query(f"WITH {_L} SELECT name, norm, key, sorted_key FROM l")
def name_normalise(spark: SparkSession, d: str) -> DataFrame:
    return entities.named(table(spark, d, "term_occ", "company"), "company").select("name", "norm", "key", "sorted_key")


@query(_MATCH + " SELECT name, matched FROM mm WHERE level = 1")
def entity_match_exact(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).where("level = 1").select("name", "matched")


@query(_MATCH + " SELECT name, matched FROM mm WHERE level <= 2")
def entity_match_key(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).where("level <= 2").select("name", "matched")


@query(_MATCH + " SELECT name, CAST(level AS INT) AS level, matched, round(score, 9) AS score FROM mm")
def entity_match_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).withColumn("score", F.round("score", 9))


@query(f"SELECT norm, min(dldte)::VARCHAR AS event_date FROM (SELECT {_NORM('conm')} AS norm, dldte FROM bankrupt_all) WHERE norm <> '' GROUP BY norm")
def earliest_event(spark: SparkSession, d: str) -> DataFrame:
    return entities.earliest_events(table(spark, d, "bankrupt_all", "conm", "dldte"), "conm", "dldte").withColumn("event_date", F.col("event_date").cast("string"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Earliest event of each company that matched a name."""
    dates = table(spark, d, "bankrupt_all", "conm", "dldte").groupBy(F.col("conm").alias("matched")).agg(F.min("dldte").alias("event_date"))
    return _matches(spark, d).join(dates, "matched").select(F.col("name").alias("company"), "event_date")


_EVENT = ", ev AS (SELECT mm.name AS company, min(dldte) AS event_date FROM mm JOIN bankrupt_all b ON b.conm = mm.matched GROUP BY mm.name)"


@query(_MATCH + _EVENT + " SELECT company, call_id, date_diff('day', file_date, event_date) AS days FROM (SELECT DISTINCT company, call_id, file_date FROM term_occ) JOIN ev USING (company)")
def days_to_event(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "term_occ", "company", "call_id", "file_date").distinct()
    return calls.join(_events(spark, d), "company").select("company", "call_id", F.datediff("event_date", "file_date").cast("bigint").alias("days"))


# -- importance
_MODES = ("role_early", "role_late", "cause_early", "cause_late")
_ALL = SQL.rstrip() + _SCORE + f", {UNITS}, {PM}, " + _MATCH.replace("WITH ", "", 1) + _EVENT + """, zs AS (SELECT DISTINCT company, z_label FROM occ WHERE company IS NOT NULL AND z_label IS NOT NULL),
pk AS (SELECT company, term, max(peak) FILTER (stage = 'early') AS time_early, max(peak) FILTER (stage = 'late') AS time_late FROM (SELECT company, term, stage, file_date AS peak FROM (SELECT company, term, stage, file_date, count(*) AS n FROM ts GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY company, term, stage ORDER BY n DESC, file_date) = 1) GROUP BY ALL),
firm AS (SELECT DISTINCT company, trim(split_part(company, ',', 1)) AS company_id FROM sco),
im AS (SELECT f.company_id AS company, s.term, z.z_label, s.main_role AS role_early, s.main_role AS role_late, s.cause_early, s.cause_late, s.term_score, s.early_n_sent, s.late_n_sent, e.event_date, time_early, time_late,
 coalesce(p, 0) * (1 - coalesce(p, 0)) * coalesce(ue.unit_logit, 0) * s.early_n_sent AS imp_early, coalesce(p, 0) * (1 - coalesce(p, 0)) * coalesce(ul.unit_logit, 0) * s.late_n_sent AS imp_late
 FROM sco s JOIN zs z USING (company) JOIN firm f USING (company) LEFT JOIN pk ON pk.company = s.company AND pk.term = s.term LEFT JOIN ev e USING (company) LEFT JOIN units ue ON ue.role = s.main_role AND ue.risk_bucket = s.cause_early AND ue.z_label = z.z_label LEFT JOIN units ul ON ul.role = s.main_role AND ul.risk_bucket = s.cause_late AND ul.z_label = z.z_label
 LEFT JOIN pm ON pm.company_id = trim(split_part(s.company, ',', 1)) AND pm.z_label = z.z_label),
imp AS (SELECT *, imp_late - imp_early AS imp_delta FROM im),
su0 AS (SELECT company, term, z_label, avg(imp_early) AS imp_early, avg(imp_late) AS imp_late, avg(imp_delta) AS imp_delta, avg(term_score) AS term_score, """ + ", ".join(f"list({c}) AS l_{c}" for c in _MODES) + """, count(*) AS n_rows, min(event_date) AS event_date, min(time_early) AS time_early, max(time_late) AS time_late, sum(early_n_sent)::BIGINT AS early_n_sent, sum(late_n_sent)::BIGINT AS late_n_sent FROM imp GROUP BY company, term, z_label),
su AS (SELECT *, """ + ", ".join(f"coalesce((SELECT v FROM (SELECT unnest(l_{c}) AS v) WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1), 'UNKNOWN') AS mode_{c}" for c in _MODES) + """ FROM su0)"""
_IMPS = ("imp_early", "imp_late", "imp_delta")
_R6 = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _IMPS)


def _importance(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of one key are one company from here on, so its groups hold several rows."""
    types = occurrences(spark, d).where("company is not null and z_label is not null").select("company", "z_label").distinct()
    staged = _staged(spark, d)
    w = cut(tone.windows(staged, TONES))
    at = tone.peak_dates(staged).groupBy("company", "term").agg(*[F.max(F.when(F.col("stage") == s, F.col("peak"))).alias(f"time_{s}") for s in ("early", "late")])
    scored = tone.scores(cut(tone.shifts(w, TONES, RISKS)), w).join(at, ["company", "term"], "left")
    scored = scored.join(types, "company").join(_events(spark, d), "company", "left")
    scored = scored.withColumns({"company_id": F.trim(F.substring_index("company", ",", 1)), "role_early": F.col("main_role"), "role_late": F.col("main_role")})
    return importance.term_importance(scored, units(spark, d), probs(spark, d)).drop("company").withColumnRenamed("company_id", "company")


def _r6(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[(F.round(c, 6) + 0.0).alias(c) for c in _IMPS])


@query(_ALL + f" SELECT company, term, z_label, role_early, role_late, {_R6} FROM imp")
def term_importance(spark: SparkSession, d: str) -> DataFrame:
    return _r6(_importance(spark, d), "company", "term", "z_label", "role_early", "role_late")


@query(_ALL + f" SELECT company, term, z_label, mode_role_early, mode_role_late, mode_cause_early, mode_cause_late, n_rows, event_date::VARCHAR AS event_date, time_early::VARCHAR AS time_early, time_late::VARCHAR AS time_late, early_n_sent, late_n_sent, {_R6} FROM su")
def importance_summary(spark: SparkSession, d: str) -> DataFrame:
    s = importance.summary(_importance(spark, d)).withColumns({c: F.col(c).cast("string") for c in ("event_date", "time_early", "time_late")})
    return _r6(s, "company", "term", "z_label", "mode_role_early", "mode_role_late", "mode_cause_early", "mode_cause_late", "n_rows", "event_date", "time_early", "time_late", "early_n_sent", "late_n_sent")


_CLEAN = "event_date IS NOT NULL AND NOT (abs(imp_early) <= 1e-8 AND abs(imp_late) <= 1e-8 AND abs(imp_delta) <= 1e-8)"


@query(_ALL + f" SELECT company, term, z_label, {_R6} FROM su WHERE {_CLEAN}")
def importance_clean(spark: SparkSession, d: str) -> DataFrame:
    return _r6(importance.clean(importance.summary(_importance(spark, d))), "company", "term", "z_label")


@query(_ALL + f" SELECT company, term, z_label, {_R6} FROM su WHERE event_date IS NOT NULL AND imp_early <> 0 AND imp_late <> 0 AND imp_delta <> 0")
def importance_strict(spark: SparkSession, d: str) -> DataFrame:
    return _r6(importance.clean(importance.summary(_importance(spark, d)), strict=True), "company", "term", "z_label")


@query(_ALL + """, zz AS (SELECT *, abs(imp_delta) AS ad FROM su), sn AS (SELECT *, round((ad - avg(ad) OVER ()) / CASE WHEN coalesce(stddev_samp(ad) OVER (), 0) <= 1e-6 THEN 1 ELSE stddev_samp(ad) OVER () END - (term_score - avg(term_score) OVER ()) / CASE WHEN coalesce(stddev_samp(term_score) OVER (), 0) <= 1e-6 THEN 1 ELSE stddev_samp(term_score) OVER () END, 9) AS sensitivity FROM zz)
SELECT z_label, company, term, CAST(row_number() OVER (PARTITION BY z_label ORDER BY sensitivity DESC, round(ad, 9) DESC, company, term) AS INT) AS rank FROM sn QUALIFY rank <= 10""")
def group_topk(spark: SparkSession, d: str) -> DataFrame:
    return importance.group_top(importance.summary(_importance(spark, d))).select("z_label", "company", "term", "rank")


@query(_ALL + """, b AS (SELECT term, z_label, sum(abs(imp_delta)) AS w FROM su GROUP BY ALL), t AS (SELECT term, round(sum(w), 9) * CASE WHEN contains(term, ' ') THEN 1.08 ELSE 1 END AS total FROM b GROUP BY term),
dz AS (SELECT term, z_label FROM b QUALIFY row_number() OVER (PARTITION BY term ORDER BY round(w, 9) DESC, z_label) = 1), rk AS (SELECT *, row_number() OVER (ORDER BY total DESC, term) AS rank, max(total) OVER () AS largest FROM t)
SELECT term, z_label, round(greatest(pow(total / (largest + 1e-12), 1.8), 0.01) * CASE rank WHEN 1 THEN 3.5 WHEN 2 THEN 2.0 ELSE 1.0 END, 6) AS weight, CAST(rank AS INT) AS rank FROM rk JOIN dz USING (term) WHERE rank <= 200""")
def cloud_weights(spark: SparkSession, d: str) -> DataFrame:
    return importance.cloud_weights(importance.summary(_importance(spark, d))).withColumn("weight", F.round("weight", 6))
