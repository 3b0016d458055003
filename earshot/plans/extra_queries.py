"""Queries of the small shared operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earshot.functions import fixed, roles
from earshot.functions import text as T
from earshot.operators import common
from earshot.plans.base import RISKS, SQL, sentences, terms
from earshot.sources.tables import table
from earshot.sources.transcripts import best_variant, quality

Q, O = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            O[f.__name__] = sql
        return f

    return add


_EXACT = "CASE lower(trim(speaker, ' ')) " + " ".join(f"WHEN '{a}' THEN '{r}'" for a, r in fixed.ROLE_ALIASES) + " END"
_LOOSE = "CASE " + " ".join(f"WHEN contains(x, '{a}') THEN '{r}'" for a, r in fixed.ROLE_ALIASES) + " END"


_EXACT_OTHER = " ".join(f"WHEN '{a}' THEN '{r}'" for a, r in fixed.ROLE_ALIASES_OTHER)
_TITLED = "array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(trim(speaker, ' '), ' ')], ' ')"


@query(rf"SELECT speaker, CASE WHEN coalesce(trim(speaker, ' '), '') = '' THEN 'Unknown' ELSE coalesce({_EXACT.replace(' END', f' {_EXACT_OTHER} END')}, {_LOOSE}, {_TITLED}) END AS role, count(*) AS n FROM (SELECT speaker, regexp_replace(trim(lower(regexp_replace(coalesce(speaker, ''), '[^A-Za-z\s]', ' ', 'g')), ' '), '\s+', ' ', 'g') AS x FROM term_occ) GROUP BY ALL")
def role_normal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "term_occ", "speaker").groupBy("speaker", roles.normal_role(F.col("speaker")).alias("role")).agg(F.count("*").alias("n"))


_BROKER = " OR ".join(f"contains(lower(t), '{b.lower()}')" for b in fixed.BROKERS)
_PY = lambda p: p.replace("'", "''")
_TITLE_ROLE = f"CASE WHEN r IS NOT NULL THEN r WHEN {_BROKER} THEN 'Analyst' END"


@query(rf"""WITH l AS (SELECT DISTINCT call_id, sentence_id, line_id, trim(regexp_replace(x, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) AS s FROM (SELECT call_id, sentence_id, line_id, unnest([speaker, sentence_text]) AS x FROM call_lines)),
m AS (SELECT *, regexp_extract(s, '{_PY(fixed.SWITCH_TITLED)}', 2) AS t, regexp_extract(s, '{_PY(fixed.SWITCH_TITLED)}', 1) AS n FROM l),
c AS (SELECT *, {_LOOSE.replace(' END', ' END')} AS r FROM (SELECT *, regexp_replace(trim(lower(regexp_replace(t, '[^A-Za-z\s]', ' ', 'g')), ' '), '\s+', ' ', 'g') AS x FROM m)),
k AS (SELECT call_id, sentence_id, CASE WHEN regexp_matches(s, '{fixed.SWITCH_OPERATOR}') THEN 'o' WHEN regexp_matches(s, '{fixed.SWITCH_QUESTION}') THEN 'q' WHEN regexp_matches(s, '{_PY(fixed.SWITCH_NAME)}') THEN 'n' WHEN regexp_matches(s, '{_PY(fixed.SWITCH_TITLED)}') THEN 't' END AS kind, s, n, {_TITLE_ROLE} AS tr FROM c)
SELECT call_id, sentence_id, CASE kind WHEN 'n' THEN regexp_replace(s, '\s*:$', '') WHEN 't' THEN trim(n, ' ') END AS name, CASE kind WHEN 'o' THEN 'Operator' WHEN 'q' THEN 'Analyst' WHEN 't' THEN tr END AS role FROM k WHERE kind IS NOT NULL""")
def speaker_switch_lines(spark: SparkSession, d: str) -> DataFrame:
    """Labels and texts are both read: either may be the line that switches."""
    lines = table(spark, d, "call_lines", "call_id", "sentence_id", "line_id", "speaker", "sentence_text")
    lines = lines.select("call_id", "sentence_id", "line_id", F.explode(F.array("speaker", "sentence_text")).alias("x"))
    lines = lines.withColumn("x", F.trim(F.regexp_replace("x", f"^{T.SPACE}+|{T.SPACE}+$", ""))).distinct()
    return lines.select("call_id", "sentence_id", roles.switch_line(F.col("x")).alias("s")).where("s is not null").select("call_id", "sentence_id", "s.name", "s.role")


_ARGMAX = "CASE greatest(" + ", ".join(f"prob_{r}" for r in RISKS) + ") " + " ".join(f"WHEN prob_{r} THEN '{r}'" for r in RISKS) + " END"
_TOP3 = "(SELECT string_agg(n || ':' || printf('%.3f', v + 1e-9), '; ' ORDER BY v DESC, n) FROM (SELECT * FROM (VALUES " + ", ".join(f"(prob_{r}, '{r}')" for r in RISKS) + ") t(v, n) ORDER BY v DESC, n LIMIT 3))"


@query(SQL + f" SELECT call_id, sentence_id, {_ARGMAX} AS llm_pred_bucket, {_TOP3} AS llm_top3 FROM sent")
def llm_top3(spark: SparkSession, d: str) -> DataFrame:
    p = {r: F.col(f"prob_{r}") for r in RISKS}
    return sentences(spark, d).select("call_id", "sentence_id", T.first_max(p).alias("llm_pred_bucket"), T.top_labels({r: c + 1e-9 for r, c in p.items()}).alias("llm_top3"))  # off the tie of the fourth decimal


@query(SQL + " SELECT call_id, sentence_id, round(dist, 9) AS risk_distance, round(greatest(0.05, least(1, 1 - dist)), 9) AS weight FROM (SELECT call_id, sentence_id, coalesce(1 - llm_pred_prob, 1) AS dist FROM sent)")
def risk_distance_weight(spark: SparkSession, d: str) -> DataFrame:
    dist = common.risk_distance(None, [], [F.col("llm_pred_prob")])
    return sentences(spark, d).select("call_id", "sentence_id", F.round(dist, 9).alias("risk_distance"), F.round(common.sample_weight(dist), 9).alias("weight"))


@query("SELECT CAST(rec_no AS VARCHAR) AS rec_no, y_true FROM labels_y WHERE rec_no IS NOT NULL ORDER BY md5(concat_ws('|', CAST(rec_no AS VARCHAR), '42')), CAST(rec_no AS VARCHAR) LIMIT 100")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels_y", "rec_no", "y_true").where("rec_no is not null").withColumn("rec_no", F.col("rec_no").cast("string"))
    return common.hash_sample(rows, "rec_no", 100)


@query(SQL + " SELECT z_label, count(DISTINCT company) FILTER (sentiment_score <> 0) AS n_companies, count(*) FILTER (sentiment_score <> 0) AS n_nonzero, count(*) AS n FROM terms GROUP BY z_label")
def nonzero_stats(spark: SparkSession, d: str) -> DataFrame:
    some = F.col("sentiment_score") != 0
    return terms(spark, d).groupBy("z_label").agg(F.countDistinct(F.when(some, F.col("company"))).alias("n_companies"), F.count_if(some).alias("n_nonzero"), F.count("*").alias("n"))


@query("""WITH k AS (SELECT DISTINCT company FROM term_occ WHERE company IS NOT NULL), e AS (SELECT company, min(doc_id) AS d FROM documents WHERE company IS NOT NULL GROUP BY company), p AS (SELECT split_part(company, ' ', 1) AS w, min(doc_id) AS d FROM documents WHERE company IS NOT NULL GROUP BY 1)
SELECT k.company, coalesce(e.d, p.d) AS doc_id, CASE WHEN e.d IS NOT NULL THEN 'exact' WHEN p.d IS NOT NULL THEN 'prefix' ELSE 'none' END AS how FROM k LEFT JOIN e USING (company) LEFT JOIN p ON p.w = split_part(k.company, ' ', 1)""")
def document_lookup(spark: SparkSession, d: str) -> DataFrame:
    first = F.substring_index("company", " ", 1)
    calls = table(spark, d, "term_occ", "company").where("company is not null")
    return common.lookup_with_fallback(calls, table(spark, d, "documents", "doc_id", "company"), "company", "doc_id", first, first)


@query(SQL + ", g AS (SELECT company, role, count(*) AS n FROM sent GROUP BY ALL) SELECT c.company, r.role, coalesce(g.n, 0)::DOUBLE AS n FROM (SELECT DISTINCT company FROM sent) c CROSS JOIN (SELECT unnest(['CEO', 'CFO', 'COO', 'IR', 'Analyst', 'Operator']) AS role) r LEFT JOIN g ON g.company = c.company AND g.role = r.role")
def reindex_roles(spark: SparkSession, d: str) -> DataFrame:
    n = sentences(spark, d).groupBy("company", "role").agg(F.count("*").cast("double").alias("n"))
    domain = n.select("company").distinct().withColumn("role", F.explode(F.array(*[F.lit(r) for r in ("CEO", "CFO", "COO", "IR", "Analyst", "Operator")])))
    return common.reindex(n, domain, ["company", "role"], ["n"])


@query(SQL + " SELECT CASE len(string_split(term, ' ')) WHEN 1 THEN 'unigram' WHEN 2 THEN 'bigram' ELSE 'longer' END AS gram_type, count(*) AS n, count(DISTINCT term) AS n_terms FROM terms GROUP BY 1")
def gram_types(spark: SparkSession, d: str) -> DataFrame:
    size = F.size(F.split("term", " "))
    kind = F.when(size == 1, "unigram").when(size == 2, "bigram").otherwise("longer")
    return terms(spark, d).groupBy(kind.alias("gram_type")).agg(F.count("*").alias("n"), F.countDistinct("term").alias("n_terms"))


@query(r"SELECT DISTINCT company, substr(regexp_replace(regexp_replace(company, '[\\/:*?<>|\r\n]+', ' ', 'g'), '\s+', ' ', 'g'), 1, 180) AS file_name FROM term_occ WHERE company IS NOT NULL")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "term_occ", "company").where("company is not null").distinct().select("company", T.file_name(F.col("company")).alias("file_name"))


@query("SELECT rec_no FROM preds_val_ens p WHERE NOT EXISTS (SELECT 1 FROM labels_y l WHERE l.company_id = p.company_id)")
def train_membership(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "preds_val_ens", "rec_no", "company_id").join(table(spark, d, "labels_y", "company_id").distinct(), "company_id", "left_anti").select("rec_no")


@query("SELECT source, count(*) AS n, count(*) FILTER (length(trim(coalesce(text, ''), ' ')) <= 130) AS n_stubs FROM documents GROUP BY source")
def stub_documents(spark: SparkSession, d: str) -> DataFrame:
    return quality(table(spark, d, "documents", "source", "text")).groupBy("source").agg(F.count("*").alias("n"), F.count_if("is_stub").alias("n_stubs"))


@query("SELECT company, file_date::VARCHAR AS file_date, doc_id FROM (SELECT *, CASE WHEN contains(lower(coalesce(source, '')), 'transcripts') THEN 20 ELSE 25 END AS k FROM documents WHERE company IS NOT NULL AND file_date IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY company, file_date ORDER BY k, doc_id) = 1")
def transcript_ranking(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "company", "file_date", "doc_id", "source").where("company is not null and file_date is not null")
    kind = F.when(F.contains(F.lower(F.coalesce("source", F.lit(""))), F.lit("transcripts")), "raw").otherwise("other")
    best = best_variant(docs.select("company", "file_date", "doc_id", kind.alias("kind")), ["company", "file_date"], "kind")
    return best.select("company", F.col("file_date").cast("string").alias("file_date"), "doc_id")


@query(SQL + ", m AS (SELECT z_label, term, count(*) AS n FROM terms WHERE z_label IS NOT NULL GROUP BY ALL) SELECT z_label, term, n, round(n / max(n) OVER (PARTITION BY z_label), 9) AS share_of_max FROM m")
def panel_normalised(spark: SparkSession, d: str) -> DataFrame:
    n = terms(spark, d).where("z_label is not null").groupBy("z_label", "term").agg(F.count("*").alias("n"))
    most = n.groupBy("z_label").agg(F.max("n").alias("m"))  # one row a type
    return n.join(F.broadcast(most), "z_label").select("z_label", "term", "n", F.round(F.col("n") / F.col("m"), 9).alias("share_of_max"))


@query(SQL + ", a AS (SELECT role AS k, count(*) AS v FROM sent WHERE z_label = 1 GROUP BY role), b AS (SELECT role AS k, count(*) AS v FROM sent WHERE z_label = 2 GROUP BY role) SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.k = b.k")
def map_union(spark: SparkSession, d: str) -> DataFrame:
    n = lambda z: sentences(spark, d).where(F.col("z_label") == z).groupBy(F.col("role").alias("k")).agg(F.count("*").alias("v"))
    return common.union_last_wins(n(1), n(2), "k", "v")


@query(SQL + " SELECT company, term, call_id, sentence_id FROM terms ORDER BY company, term, call_id, sentence_id, rec_id LIMIT 50")
def preview_rows(spark: SparkSession, d: str) -> DataFrame:
    return terms(spark, d).orderBy("company", "term", "call_id", "sentence_id", "rec_id").limit(50).select("company", "term", "call_id", "sentence_id")


@query(SQL + ", w AS (SELECT z_label, company, avg(coalesce(llm_pred_prob, 0)) AS p FROM sent WHERE z_label IS NOT NULL GROUP BY ALL) SELECT z_label, company, CAST(row_number() OVER (PARTITION BY z_label ORDER BY round(p, 9) DESC, company) AS INT) AS rank FROM w QUALIFY rank <= 5")
def top_companies(spark: SparkSession, d: str) -> DataFrame:
    p = sentences(spark, d).where("z_label is not null").groupBy("z_label", "company").agg(F.round(F.avg(F.coalesce("llm_pred_prob", F.lit(0.0))), 9).alias("p"))
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("z_label").orderBy(F.desc("p"), "company"))).where("rank <= 5").select("z_label", "company", "rank")


@query("SELECT feature, z_label, kind FROM (SELECT DISTINCT role AS feature FROM (SELECT 'CEO|risk_legal' AS role UNION ALL SELECT 'prior_z2' UNION ALL SELECT 'intercept')) CROSS JOIN (SELECT DISTINCT y_true AS z_label FROM labels_y WHERE y_true IS NOT NULL) CROSS JOIN LATERAL (SELECT CASE WHEN starts_with(feature, 'prior_z') THEN 'gamma' ELSE 'beta' END AS kind) WHERE feature <> 'intercept'")
def coefficient_split(spark: SparkSession, d: str) -> DataFrame:
    z = table(spark, d, "labels_y", "y_true").where("y_true is not null").select(F.col("y_true").alias("z_label")).distinct()
    coefs = z.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in ("CEO|risk_legal", "prior_z2", "intercept")]))).withColumn("coef", F.lit(0.5))
    beta, gamma = common.split_coefficients(coefs)
    return beta.select(F.concat_ws("|", "role", "risk_bucket").alias("feature"), "z_label", F.lit("beta").alias("kind")).union(gamma.select(F.concat(F.lit("prior_z"), "k"), "z_label", F.lit("gamma")))
