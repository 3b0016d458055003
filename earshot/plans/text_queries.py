"""Text, lexicon and matching queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import fixed
from earshot.functions import text as T
from earshot.operators import lexicon, match
from earshot.plans.base import SQL, occurrences, sentences, sql_list, terms
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


STOP, UNITS = sql_list(fixed.STOPWORDS), sql_list(fixed.UNIT_WORDS)
SENT = fixed.SENTENCE_PATTERN.replace("'", "''")
TOKENS = "regexp_extract_all(lower(sentence_text), '[a-z]+')"
METRIC = r"regexp_extract_all(lower(translate(text, chr(12288) || chr(160), '  ')), '[a-z0-9\-]+')"


@query(rf"SELECT doc_id, CAST(i AS INT) AS sent_idx, s[i] AS sentence FROM (SELECT doc_id, regexp_extract_all(text, '{SENT}') AS s FROM documents), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i) WHERE trim(s[i], E' \t\n\r\f\x0b') <> ''")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(T.sentence_spans(F.col("text"))).alias("i", "sentence"))
    return spans.where(F.regexp_replace("sentence", r"[ \t\n\r\f\x0b]", "") != "").select("doc_id", (F.col("i") + 1).cast("int").alias("sent_idx"), "sentence")


@query(rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '{SENT}')) AS BIGINT) AS n_sentences, CAST(len({METRIC}) AS BIGINT) AS n_tokens FROM documents WHERE text IS NOT NULL")
def sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    return t.select("doc_id", F.size(T.sentence_spans(F.col("text"))).cast("bigint").alias("n_sentences"), F.size(T.metric_tokens(F.col("text"))).cast("bigint").alias("n_tokens"))


@query(rf"SELECT w AS token, count(*) AS n FROM (SELECT unnest({METRIC}) AS w FROM documents) GROUP BY w")
def metric_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "text").select(F.explode(T.metric_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT w AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]*')) AS w FROM documents) GROUP BY w")
def english_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "text").select(F.explode(T.english_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


# the classes that (?U) stands for, spelled out
_WS, _W = r"[\s\x0b\x{85}\p{Z}]", r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}\x{24b6}-\x{24e9}"
_UPPER = r"\p{Lu}\x{2160}-\x{216f}\x{24b6}-\x{24cf}\x{1f130}-\x{1f149}\x{1f150}-\x{1f169}\x{1f170}-\x{1f189}"
_LOWER = r"\p{Ll}\p{Lt}\x{aa}\x{ba}\x{2b0}-\x{2b8}\x{2c0}-\x{2c1}\x{2e0}-\x{2e4}\x{345}\x{37a}\x{1d2c}-\x{1d6a}\x{1d78}\x{1d9b}-\x{1dbf}\x{2071}\x{207f}\x{2090}-\x{209c}\x{2170}-\x{217f}\x{24d0}-\x{24e9}\x{2c7c}-\x{2c7d}"
_HEADER = f"(^|[^{_W}])(" + fixed.HEADER_PATTERN.replace(r"\b", "").replace(r"\s", _WS) + f")($|[^{_W}])"


@query(rf"""SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '(?i)\(operator instructions\)', ' ', 'g'), '\n{_WS}*\n'),
  lambda p: regexp_replace(p, '^\p{{Z}}+|\p{{Z}}+$', '', 'g') = '' OR NOT (regexp_matches(lower(p), '{_HEADER}') OR regexp_full_match(regexp_replace(p, '^\p{{Z}}+|\p{{Z}}+$', '', 'g'), '\p{{Nd}}{{2}}:\p{{Nd}}{{2}}:\p{{Nd}}{{2}}')
    OR (length(regexp_replace(p, '^{_WS}+|{_WS}+$', '', 'g')) <= 60 AND regexp_matches(p, '[{_UPPER}]') AND NOT regexp_matches(p, '[{_LOWER}]')))), chr(10) || chr(10)) AS text FROM documents WHERE text IS NOT NULL""")
def header_paragraph_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", T.drop_headers(F.col("text")).alias("text"))


_SPACE = T.SPACE.replace("\\x{85}", chr(0x85))
_HIDE = "text"
_SHOW = "s"
for _a in fixed.PROTECTED:
    _b = _a.replace(".", "\ue000")
    _HIDE, _SHOW = f"replace({_HIDE}, '{_a}', '{_b}')", f"replace({_SHOW}, '{_b}', '{_a}')"


@query(rf"SELECT doc_id, CAST(i - 1 AS INT) AS sent_idx, p[i] AS sentence FROM (SELECT doc_id, list_filter([regexp_replace({_SHOW}, '^{_SPACE}+|{_SPACE}+$', '', 'g') FOR s IN string_split(regexp_replace({_HIDE}, '([。！？!?.]){_SPACE}+', '\1' || chr(57345), 'g'), chr(57345))], lambda x: length(x) >= 2) AS p FROM documents), LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)")
def abbrev_sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(T.protected_sentences(F.col("text"))).alias("sent_idx", "sentence"))


_SHORT = lambda x: rf"(len(regexp_extract_all(lower(translate({x}, chr(12288) || chr(160), '  ')), '[a-z0-9\-]+')) < 3 OR length(regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g')) < 10)"


@query(rf"SELECT doc_id, CAST(i - 1 AS INT) AS sent_idx, m[i] AS sentence FROM (SELECT doc_id, list_reduce([[x] FOR x IN regexp_extract_all(text, '{SENT}')], lambda a, b: CASE WHEN {_SHORT('b[1]')} OR {_SHORT('a[len(a)]')} THEN list_concat(a[1:len(a) - 1], [a[len(a)] || b[1]]) ELSE list_concat(a, b) END) AS m FROM documents WHERE len(regexp_extract_all(text, '{SENT}')) > 0), LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i)")
def short_sentence_merge(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(T.merge_short(T.sentence_spans(F.col("text")))).alias("sent_idx", "sentence"))


_GRAMS = SQL + f""", tok AS (SELECT call_id, {TOKENS} AS t FROM sent),
g AS (SELECT n, array_to_string(t[i:i + n - 1], ' ') AS term FROM tok, (SELECT unnest([1, 2, 3]) AS n), LATERAL (SELECT unnest(range(1, len(t) - n + 2)) AS i))"""


@query(_GRAMS + " SELECT CAST(n AS INT) AS n, term, count(*) AS freq FROM g GROUP BY n, term HAVING count(*) >= CASE n WHEN 3 THEN 3 ELSE 5 END")
def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.ngram_counts(sentences(spark, d), "sentence_text", {1: 5, 2: 5, 3: 3})


@query(_GRAMS + f" SELECT CAST(n AS INT) AS n, term, count(*) AS freq FROM g WHERE NOT list_bool_and([w IN ({STOP}) FOR w IN string_split(term, ' ')]) GROUP BY n, term HAVING count(*) >= CASE n WHEN 3 THEN 3 ELSE 5 END")
def ngram_stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.ngram_counts(sentences(spark, d), "sentence_text", {1: 5, 2: 5, 3: 3}, drop_stopwords=True)


@query(_GRAMS + f", c AS (SELECT array_to_string([w FOR w IN string_split(term, ' ') IF w NOT IN ({STOP}, {UNITS})], ' ') AS term FROM g) SELECT term, count(*) AS freq FROM c WHERE term <> '' GROUP BY term")
def content_ngrams(spark: SparkSession, d: str) -> DataFrame:
    grams = lexicon.all_ngrams(sentences(spark, d), "sentence_text", (1, 2, 3))
    return grams.select(T.content_gram(F.col("term")).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("freq"))


# -- lexicons: a wide table of flags by term stands in for the dictionary file
_FLAGS = SQL + ", wide AS (SELECT term, CAST(avg(sentiment_score) < 0 AS INT) AS negative, CAST(avg(uncertainty_score) > 0.1 AS INT) AS uncertainty, CAST(avg(prob_risk_legal) > 0.3 AS INT) AS litigious, CAST(avg(prob_risk_constraint) > 0.3 AS INT) AS constraining FROM terms GROUP BY term)"
_BUCKETS = ["negative", "uncertainty", "litigious", "constraining"]


def _wide(spark: SparkSession, d: str) -> DataFrame:
    t = terms(spark, d).groupBy("term")
    flag = lambda c: c.cast("int")
    return t.agg(
        flag(F.avg("sentiment_score") < 0).alias("negative"), flag(F.avg("uncertainty_score") > 0.1).alias("uncertainty"), flag(F.avg("prob_risk_legal") > 0.3).alias("litigious"), flag(F.avg("prob_risk_constraint") > 0.3).alias("constraining")
    )


_LONG = _FLAGS + ", long AS (" + " UNION ALL ".join(f"SELECT 'lm_{b}' AS bucket, term FROM wide WHERE {b} > 0" for b in _BUCKETS) + f" UNION ALL SELECT 'lm_general', term FROM wide WHERE NOT ({' OR '.join(f'coalesce({b}, 0) > 0' for b in _BUCKETS)}))"


@query(_LONG + " SELECT bucket, term FROM long")
def lexicon_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.unpivot_flags(_wide(spark, d), _BUCKETS, "lm_", "lm_general")


_PHRASES = ", both2 AS (SELECT * FROM long UNION SELECT DISTINCT 'flr_' || role, term FROM terms WHERE contains(term, ' '))"


@query(_LONG + _PHRASES + " SELECT bucket, array_to_string(list_sort(list(term)), ';') AS terms, count(*) AS n FROM both2 GROUP BY bucket")
def lexicon_merge(spark: SparkSession, d: str) -> DataFrame:
    flags = lexicon.unpivot_flags(_wide(spark, d), _BUCKETS, "lm_", "lm_general")
    phrases = terms(spark, d).where(F.contains("term", F.lit(" "))).select(F.concat(F.lit("flr_"), "role").alias("bucket"), "term")
    return lexicon.merge([flags, phrases]).select("bucket", F.array_join("terms", ";").alias("terms"), F.size("terms").cast("bigint").alias("n"))


_THEME = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(term), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in fixed.THEMES) + f" ELSE '{fixed.THEME_OTHER}' END"


@query(SQL + f" SELECT {_THEME} AS theme, count(*) AS n, count(DISTINCT term) AS n_terms FROM terms GROUP BY 1")
def lexicon_theme_map(spark: SparkSession, d: str) -> DataFrame:
    return terms(spark, d).groupBy(T.theme(F.col("term")).alias("theme")).agg(F.count("*").alias("n"), F.countDistinct("term").alias("n_terms"))


@query(SQL + """, a AS (SELECT t, count(*) AS f FROM (SELECT unnest(list_distinct(string_split(term, ' '))) AS t FROM (SELECT DISTINCT term FROM terms WHERE prob_risk_legal < 0.2)) WHERE length(t) >= 3 GROUP BY t),
b AS (SELECT t, count(*) AS r FROM (SELECT unnest(list_distinct(string_split(term, ' '))) AS t FROM (SELECT DISTINCT term FROM terms WHERE prob_risk_legal > 0.5)) WHERE length(t) >= 3 GROUP BY t),
j AS (SELECT coalesce(a.t, b.t) AS token, coalesce(f, 0) AS n_financial, coalesce(r, 0) AS n_risk FROM a FULL JOIN b ON a.t = b.t)
SELECT token, n_financial, n_risk, CASE WHEN n_financial >= 5 AND n_financial >= 2 * greatest(n_risk, 1) THEN 'financial' ELSE 'risk' END AS core FROM j
WHERE (n_financial >= 5 AND n_financial >= 2 * greatest(n_risk, 1)) OR (n_risk >= 5 AND n_risk >= 2 * greatest(n_financial, 1))""")
def core_token_learning(spark: SparkSession, d: str) -> DataFrame:
    t = terms(spark, d)
    return lexicon.core_tokens(t.where("prob_risk_legal < 0.2").select("term").distinct(), t.where("prob_risk_legal > 0.5").select("term").distinct())


@query(SQL + ", l AS (SELECT sentence_text || '@' || coalesce(cast(z_label AS VARCHAR), '') AS v FROM sent) SELECT regexp_extract(v, '(?s)^(.*)@([^@]*)$', 2) AS label, count(*) AS n, sum(length(regexp_extract(v, '(?s)^(.*)@([^@]*)$', 1)))::BIGINT AS n_chars FROM l WHERE v IS NOT NULL GROUP BY 1")
def phrase_label_parse(spark: SparkSession, d: str) -> DataFrame:
    lines = sentences(spark, d).select(F.concat("sentence_text", F.lit("@"), F.coalesce(F.col("z_label").cast("string"), F.lit(""))).alias("value"))
    return lexicon.labelled_phrases(lines).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("phrase")).alias("n_chars"))


@query("SELECT k AS key, count(*) AS n, count(DISTINCT json_extract_string(props, '$.' || k)) AS n_values FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def json_map_explode(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.json_entries(table(spark, d, "events", "props"), "props").groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


# -- matching
_LEX = ["capital", "working capital", "debt", "net debt", "covenant", "cash flow", "term loan", "credit", "credit line", "fair value", "interest expense", "tax credit"]
_SUPPLY = ["demand", "prices", "shift", "plant", "orders", "freight volumes", "second shift"]
_HITS = "SELECT i, max(len(l)) AS len FROM (SELECT unnest(range(1, len(t) + 1)) AS i), (SELECT string_split(unnest([{}]), ' ') AS l) WHERE t[i:i + len(l) - 1] = l GROUP BY i"


@query(SQL + f", tok AS (SELECT call_id, sentence_id, {METRIC.replace('text', 'sentence_text')} AS t FROM sent) SELECT call_id, sentence_id, CAST(i AS INT) AS start_idx, array_to_string(t[i:i + len - 1], ' ') AS term FROM tok, LATERAL ({_HITS.format(sql_list(_LEX))})")
def phrase_match_longest(spark: SparkSession, d: str) -> DataFrame:
    s = sentences(spark, d).select("call_id", "sentence_id", T.metric_tokens(F.col("sentence_text")).alias("tokens"))
    return match.longest_phrases(s, _LEX, ["call_id", "sentence_id"])


@query(SQL + f""", tok AS (SELECT call_id, sentence_id, {METRIC.replace('text', 'sentence_text')} AS t FROM sent), w AS (SELECT DISTINCT term FROM terms),
g AS (SELECT call_id, sentence_id, i, n, array_to_string(t[i:i + n - 1], ' ') AS term FROM tok, (SELECT DISTINCT len(string_split(term, ' ')) AS n FROM w), LATERAL (SELECT unnest(range(1, len(t) - n + 2)) AS i))
SELECT call_id, sentence_id, CAST(i AS INT) AS start_idx, term FROM g SEMI JOIN w USING (term) QUALIFY row_number() OVER (PARTITION BY call_id, sentence_id, i ORDER BY n DESC) = 1""")
def phrase_match_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Every term of the table as the dictionary."""
    s = sentences(spark, d).select("call_id", "sentence_id", T.metric_tokens(F.col("sentence_text")).alias("tokens"))
    return match.dictionary_hits(s, cut(terms(spark, d).select("term").distinct()), ["call_id", "sentence_id"])


@query(SQL + f""", tok AS (SELECT call_id, sentence_id, {METRIC.replace('text', 'sentence_text')} AS t FROM sent),
h AS (SELECT call_id, sentence_id, (SELECT list(i) FROM ({_HITS.format(sql_list(_LEX))})) AS risk, (SELECT list(i) FROM ({_HITS.format(sql_list(_SUPPLY))})) AS supply, len(t) AS n FROM tok)
SELECT call_id, sentence_id, CAST(n AS INT) AS token_len, CAST(coalesce(len(list_filter(supply, lambda s: len(list_filter(risk, lambda r: abs(r - s) <= 10)) > 0)), 0) AS INT) AS near_count,
  round(coalesce(len(list_filter(supply, lambda s: len(list_filter(risk, lambda r: abs(r - s) <= 10)) > 0)), 0) / greatest(n, 1), 6) AS near_ratio FROM h""")
def proximity_count(spark: SparkSession, d: str) -> DataFrame:
    s = sentences(spark, d).select("call_id", "sentence_id", T.metric_tokens(F.col("sentence_text")).alias("tokens"))
    return match.proximity(s, _LEX, _SUPPLY, 10, ["call_id", "sentence_id"])


_IN = lambda words: f"len([w FOR w IN t IF w IN ({sql_list(words)})])"


@query(SQL + f""", tok AS (SELECT call_id, sentence_id, lower(sentence_text) AS s, {TOKENS} AS t FROM sent WHERE sentence_text IS NOT NULL)
SELECT call_id, sentence_id, round((len(list_distinct([w FOR w IN t IF w IN ({sql_list(fixed.RISK_WORDS)})])) + CAST(contains(s, 'going concern') AS INT)) / (len(t) + 1.0), 6) AS risk,
 round(({_IN(fixed.POSITIVE_WORDS)} - {_IN(fixed.NEGATIVE_WORDS)}) / (len(t) + 1.0), 6) AS sentiment, round({_IN(fixed.UNCERTAINTY_WORDS)} / (len(t) + 1.0), 6) AS uncertainty,
 CASE WHEN len(t) > 0 AND ({' OR '.join(f"contains(s, '{p}')" for p in fixed.HEDGING_PHRASES)}) THEN 1.0 ELSE 0.0 END AS hedging, round({_IN(fixed.COMMITMENT_WORDS)} / (len(t) + 1.0), 6) AS commitment FROM tok""")
def lexical_tone(spark: SparkSession, d: str) -> DataFrame:
    tone = match.lexical_tone(F.col("sentence_text"))
    return sentences(spark, d).where("sentence_text is not null").select("call_id", "sentence_id", *[F.round(c, 6).alias(n) for n, c in tone.items()])


_CLASS = r"\p{L}\p{M}\p{N}_"
_EDGE = f"""CASE WHEN regexp_matches(term, '^[a-z]') THEN '(^|[^a-z])' WHEN regexp_matches(term, '^[{_CLASS}]') THEN '(^|[^{_CLASS}])' ELSE '' END || regexp_escape(term) || CASE WHEN regexp_matches(term, '[a-z]$') THEN '($|[^a-z])' WHEN regexp_matches(term, '[{_CLASS}]$') THEN '($|[^{_CLASS}])' ELSE '' END"""


@query(SQL + f""", tok AS (SELECT call_id, sentence_id, {TOKENS} AS t FROM sent), w AS (SELECT DISTINCT term FROM terms), l AS (SELECT term FROM w WHERE regexp_full_match(term, '[a-z]+( [a-z]+)*')),
g AS (SELECT DISTINCT call_id, sentence_id, array_to_string(t[i:i + n - 1], ' ') AS term FROM tok, (SELECT DISTINCT len(string_split(term, ' ')) AS n FROM l), LATERAL (SELECT unnest(range(1, len(t) - n + 2)) AS i)),
o AS (SELECT term, {_EDGE} AS whole FROM w WHERE NOT regexp_full_match(term, '[a-z]+( [a-z]+)*')), low AS (SELECT call_id, sentence_id, lower(sentence_text) AS s FROM sent)
SELECT term, count(*) AS n, count(DISTINCT call_id) AS n_calls FROM (SELECT * FROM g SEMI JOIN l USING (term) UNION ALL SELECT call_id, sentence_id, term FROM low JOIN o ON contains(low.s, o.term) WHERE regexp_matches(s, whole)) GROUP BY term""")
def term_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Every term, of any signs and length."""
    t, plain = cut(terms(spark, d).select("term").distinct()), F.col("term").rlike("^[a-z]+( [a-z]+)*$")
    s = cut(sentences(spark, d).select("call_id", "sentence_id", "sentence_text"))  # read once for each kind of term
    found = match.term_occurrences(s, t.where(plain), t.where(~plain), ["call_id", "sentence_id"], "sentence_text")
    return found.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("call_id").alias("n_calls"))


@query(_LONG + ", f AS (SELECT term, array_to_string(list_sort(list_distinct(list(bucket))), ';') AS categories FROM long GROUP BY term) SELECT DISTINCT t.term, CASE WHEN categories IS NULL THEN 0 ELSE 1 END AS in_lexicon, coalesce(categories, '') AS categories FROM terms t LEFT JOIN f USING (term)")
def lexicon_membership(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.membership(terms(spark, d).select("term").distinct(), lexicon.unpivot_flags(_wide(spark, d), _BUCKETS, "lm_", "lm_general"))


@query(r"SELECT doc_id, file_date::VARCHAR AS parsed, CASE WHEN contains(coalesce(text, ''), 'Earnings Call') THEN nullif(regexp_extract(text, '\b(Q[1-4]\s+\d{4})\b', 1), '') END AS quarter FROM documents WHERE file_date IS NOT NULL")
def document_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates written in four forms by turns and read back."""
    q = F.when(F.contains(F.coalesce("text", F.lit("")), F.lit("Earnings Call")), F.nullif(F.regexp_extract("text", r"\b(Q[1-4]\s+\d{4})\b", 1), F.lit("")))
    forms = F.array(*[F.date_format("file_date", f) for f in ("'Call of 'yyyy-MM-dd", "'call_'yyyyMMdd", "d-MMM-yyyy", "M/d/yyyy' 10:00'")])
    written = F.get(forms, F.pmod(F.xxhash64("doc_id"), F.lit(4)).cast("int"))
    return table(spark, d, "documents", "doc_id", "text", "file_date").where("file_date is not null").select("doc_id", T.parse_date(written).cast("string").alias("parsed"), q.alias("quarter"))


@query(SQL + ", k AS (SELECT DISTINCT company || '_' || strftime(file_date, '%Y-%m-%d') || '_' || quarter_label AS doc_id FROM occ WHERE company IS NOT NULL) SELECT doc_id, regexp_extract(doc_id, '^(.*)_(\\d{4}-\\d{2}-\\d{2})_Q(\\d)\\s*(\\d{4})$', 1) AS company, trim(split_part(split_part(doc_id, '_', 1), ',', 1)) AS company_id, try_cast(nullif(regexp_extract(doc_id, '^(.*)_(\\d{4}-\\d{2}-\\d{2})_Q(\\d)\\s*(\\d{4})$', 2), '') AS DATE)::VARCHAR AS file_date, try_cast(nullif(regexp_extract(doc_id, '^(.*)_(\\d{4}-\\d{2}-\\d{2})_Q(\\d)\\s*(\\d{4})$', 3), '') AS INT) AS quarter, try_cast(nullif(regexp_extract(doc_id, '^(.*)_(\\d{4}-\\d{2}-\\d{2})_Q(\\d)\\s*(\\d{4})$', 4), '') AS INT) AS fiscal_year FROM k WHERE doc_id IS NOT NULL".replace("\\\\", "\\"))
def document_id_parts(spark: SparkSession, d: str) -> DataFrame:
    o = occurrences(spark, d).where("company is not null")
    doc = o.select(F.concat("company", F.lit("_"), F.date_format("file_date", "yyyy-MM-dd"), F.lit("_"), "quarter_label").alias("doc_id")).where("doc_id is not null").distinct()
    parts = T.document_parts(F.col("doc_id"))
    return doc.select("doc_id", *[c.cast("string" if n == "file_date" else c_type).alias(n) for n, c, c_type in ((n, c, "int" if n in ("quarter", "fiscal_year") else "string") for n, c in parts.items())])
