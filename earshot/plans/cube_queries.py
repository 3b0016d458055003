"""Speaker and cube queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earshot.functions import fixed, roles
from earshot.operators import cubes, speakers
from earshot.plans.base import RISKS, SQL, occurrences, sentences, sql_list
from earshot.sources.tables import table

Q, O = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            O[f.__name__] = sql
        return f

    return add


@query(SQL + """ SELECT call_id, sentence_id, concat_ws(' ', '[SPEAKER=' || role || ']', CASE WHEN p <> '' THEN '[CTX_BEFORE] ' || p END, sentence_text, CASE WHEN n <> '' THEN '[CTX_AFTER] ' || n END) AS input FROM (
SELECT *, coalesce(string_agg(sentence_text, ' ') OVER (PARTITION BY call_id ORDER BY sentence_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS p, coalesce(string_agg(sentence_text, ' ') OVER (PARTITION BY call_id ORDER BY sentence_id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS n FROM sent)""")
def context_window(spark: SparkSession, d: str) -> DataFrame:
    s = sentences(spark, d)
    return s.select("call_id", "sentence_id", speakers.context_window(s, "call_id", ["sentence_id"], "sentence_text", F.col("role")).alias("input"))


@query(SQL + " SELECT call_id, sentence_id, coalesce(last_value(CASE WHEN role <> 'Unknown' THEN role END IGNORE NULLS) OVER (PARTITION BY call_id ORDER BY sentence_id ROWS UNBOUNDED PRECEDING), 'Unknown') AS role FROM sent")
def role_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    filled = speakers.forward_fill(F.when(F.col("role") != "Unknown", F.col("role")), "call_id", ["sentence_id"])
    return sentences(spark, d).select("call_id", "sentence_id", F.coalesce(filled, F.lit("Unknown")).alias("role"))


@query(SQL + """, c AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS ch FROM sent WINDOW w AS (PARTITION BY call_id ORDER BY sentence_id)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY call_id ORDER BY sentence_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM c)
SELECT call_id, island, any_value(role) AS role, min(sentence_id) AS first, max(sentence_id) AS last, count(*) AS n FROM i GROUP BY call_id, island""")
def role_islands(spark: SparkSession, d: str) -> DataFrame:
    return speakers.islands(sentences(spark, d), "role", "call_id", ["sentence_id"])


@query(SQL + " SELECT speaker, role, count(*) AS n FROM occ GROUP BY speaker, role")
def role_canonical(spark: SparkSession, d: str) -> DataFrame:
    return occurrences(spark, d).groupBy("speaker", "role").agg(F.count("*").alias("n"))


@query(SQL + """, r AS (SELECT call_id, role, row_number() OVER (PARTITION BY call_id ORDER BY sentence_id) AS idx FROM sent WHERE role <> 'Unknown'),
s AS (SELECT call_id, sentence_id, row_number() OVER (PARTITION BY call_id ORDER BY sentence_id) AS idx FROM sent)
SELECT s.call_id, s.sentence_id, CAST(s.idx AS INT) AS idx, coalesce(r.role, 'IR') AS role FROM s LEFT JOIN r ON s.call_id = r.call_id AND s.idx = r.idx""")
def role_positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """The known roles in order: a list shorter than the sentences, as another splitter makes it."""
    s = sentences(spark, d)
    return speakers.positional_zip(s.select("call_id", "sentence_id"), s.where("role <> 'Unknown'").select("call_id", "sentence_id", "role"), "call_id", "sentence_id", "role")


@query()
def role_rebalance(spark: SparkSession, d: str) -> DataFrame:
    return speakers.rebalance(sentences(spark, d), "call_id", "sentence_id", "role", "sentence_text")


_ALLOWED = ["CEO", "CFO", "Analyst", "Operator", "IR"]


@query(SQL + f""", x AS (SELECT call_id, sentence_id, role, row_number() OVER (PARTITION BY call_id ORDER BY sentence_id) - 1 AS idx, count(*) OVER (PARTITION BY call_id) AS n, min(role) OVER (PARTITION BY call_id) = max(role) OVER (PARTITION BY call_id) AS one FROM sent)
SELECT call_id, sentence_id, CASE WHEN one AND n >= 10 AND idx % 7 = 0 THEN [{sql_list(_ALLOWED)}][idx % 5 + 1] ELSE role END AS role FROM x""")
def role_degenerate_fix(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("call_id")
    index = F.row_number().over(w.orderBy("sentence_id")) - 1
    n_roles = F.when(F.min("role").over(w) == F.max("role").over(w), 1).otherwise(2)
    return sentences(spark, d).select("call_id", "sentence_id", speakers.degenerate_fix(F.col("role"), index, n_roles, F.count("*").over(w), _ALLOWED).alias("role"))


_COUNT = lambda ws: " + ".join(f"CAST(contains(s, '{w}') AS INT)" for w in ws)


@query(SQL + f""", t AS (SELECT call_id, sentence_id, lower(coalesce(sentence_text, '')) AS s FROM sent) SELECT call_id, sentence_id,
 {_COUNT(fixed.ROLE_PHRASES['Operator'])} + CASE WHEN contains(s, 'welcome to') OR contains(s, 'please stand by') OR contains(s, 'operator instructions') THEN 3.0 ELSE 0 END AS operator,
 {_COUNT(fixed.ROLE_PHRASES['Analyst'])} + CASE WHEN contains(s, '?') OR starts_with(trim(s), 'q:') OR starts_with(trim(s), 'question:') THEN 2.5 ELSE 0 END AS analyst,
 round({_COUNT(fixed.ROLE_PHRASES['CFO'])} + CASE WHEN len(regexp_extract_all(s, '\\d+(\\.\\d+)?')) >= 2 THEN 0.6 ELSE 0 END, 6)::DOUBLE AS cfo,
 CASE WHEN {' OR '.join(f"contains(s, '{w}')" for w in fixed.ROLE_PHRASES['Operator'])} THEN 'Operator' WHEN {' OR '.join(f"contains(s, '{w}')" for w in fixed.ROLE_PHRASES['Analyst'])} THEN 'Analyst'
  WHEN {_COUNT(fixed.ROLE_PHRASES['CFO'])} >= 2 THEN 'CFO' WHEN {_COUNT(fixed.ROLE_PHRASES['CEO'])} >= 2 THEN 'CEO' WHEN {_COUNT(fixed.ROLE_PHRASES['IR'])} >= 2 THEN 'IR' END AS by_phrases FROM t""")
def role_scores(spark: SparkSession, d: str) -> DataFrame:
    s = roles.role_scores(F.col("sentence_text"))
    return sentences(spark, d).select("call_id", "sentence_id", s["Operator"].alias("operator"), s["Analyst"].alias("analyst"), F.round(s["CFO"], 6).alias("cfo"), roles.role_by_phrases(F.col("sentence_text")).alias("by_phrases"))


@query()
def speaker_name_match(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "call_lines", "call_id", "speaker").where("speaker is not null")
    label = F.col("speaker")
    full = lines.where(speakers.full_label(label)).groupBy("call_id").agg(F.array_sort(F.collect_set(speakers.label_name(label))).alias("roster"))
    named = lines.distinct().withColumn("name", speakers.label_name(label))
    return speakers.match_names(named.join(full, "call_id", "left"), "name", "roster").select("call_id", "speaker", "matched", F.round("ratio", 6).alias("ratio"))


def _transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Each call of the caption lines as a transcript: a participants block of its labels, then its lines behind their speakers."""
    lines = table(spark, d, "call_lines", "call_id", "sentence_id", "line_id", "speaker", "sentence_text").where("call_id is not null").dropDuplicates(["call_id", "sentence_id", "line_id"])
    said = F.concat(F.coalesce(F.concat("speaker", F.lit("\n")), F.lit("")), F.coalesce("sentence_text", F.lit("")))
    whole = lines.groupBy("call_id").agg(F.array_sort(F.collect_set("speaker")).alias("who"), F.array_sort(F.collect_list(F.struct("sentence_id", "line_id", said.alias("x")))).alias("lines"))
    return whole.select("call_id", F.concat(F.lit("Corporate Participants\n"), F.array_join("who", "\n"), F.lit("\nPresentation\n"), F.array_join(F.col("lines.x"), "\n")).alias("text"))


@query()
def participants_header(spark: SparkSession, d: str) -> DataFrame:
    found = _transcripts(spark, d).select("call_id", F.explode(speakers.participants(F.col("text"))).alias("p"))
    return found.select("call_id", "p.name", "p.role")


@query()
def transcript_roles(spark: SparkSession, d: str) -> DataFrame:
    return speakers.transcript_roles(_transcripts(spark, d), "call_id", "text")


@query(SQL + ", v AS (SELECT call_id, sentence_id, CASE WHEN role <> 'Unknown' THEN role END AS r FROM sent) SELECT call_id, sentence_id, coalesce(r, lag(r, 1) OVER w, lead(r, 1) OVER w, lag(r, 2) OVER w, lead(r, 2) OVER w, lag(r, 3) OVER w, lead(r, 3) OVER w, 'IR') AS role FROM v WINDOW w AS (PARTITION BY call_id ORDER BY sentence_id)")
def role_fill_near(spark: SparkSession, d: str) -> DataFrame:
    near = speakers.fill_near(F.when(F.col("role") != "Unknown", F.col("role")), "call_id", ["sentence_id"])
    return sentences(spark, d).select("call_id", "sentence_id", F.coalesce(near, F.lit("IR")).alias("role"))


# -- cubes
_SUMS = ", ".join(f"sum(prob_{r}) AS {r}" for r in RISKS)
_TOTAL = " + ".join(RISKS)


@query(SQL + f", g AS (SELECT company, role, source_type, {_SUMS}, count(*) AS n_sent FROM (SELECT *, 'Type_' || z_label AS source_type FROM sent) GROUP BY ALL), u AS (SELECT *, {_TOTAL} AS total FROM g) SELECT company, role, source_type, risk_bucket, round(s, 6) AS sum_prob, n_sent, round(CASE WHEN total > 0 THEN s / total ELSE 0 END, 9) AS a_mij FROM u UNPIVOT (s FOR risk_bucket IN ({', '.join(RISKS)}))")
def a_mij(spark: SparkSession, d: str) -> DataFrame:
    s = sentences(spark, d).withColumn("source_type", F.concat(F.lit("Type_"), F.col("z_label").cast("string")))
    out = cubes.shares(s, ["company", "role", "source_type"])
    return out.select("company", "role", "source_type", "risk_bucket", F.round("sum_prob", 6).alias("sum_prob"), "n_sent", F.round("a_mij", 9).alias("a_mij"))


def pool_sql(keys: str) -> str:
    return f"SELECT {keys}, risk_bucket, s AS sum_s, s / n_sent AS mean_s, n_sent FROM (SELECT {keys}, {_SUMS}, count(*) AS n_sent FROM sent WHERE z_label IS NOT NULL GROUP BY {keys}) UNPIVOT (s FOR risk_bucket IN ({', '.join(RISKS)}))"


@query(SQL + f"SELECT role, z_label, risk_bucket, round(sum_s, 6) AS sum_s, round(mean_s, 9) AS mean_s, n_sent FROM ({pool_sql('role, z_label')})")
def s_pool(spark: SparkSession, d: str) -> DataFrame:
    p = cubes.pool(sentences(spark, d).where("z_label is not null"), ["role", "z_label"])
    return p.select("role", "z_label", "risk_bucket", F.round("sum_s", 6).alias("sum_s"), F.round("mean_s", 9).alias("mean_s"), "n_sent")


@query(SQL + f"SELECT company, call_id, role, z_label, risk_bucket, round(sum_s, 6) AS sum_s, round(mean_s, 9) AS mean_s, n_sent FROM ({pool_sql('company, call_id, role, z_label')})")
def s_per_company(spark: SparkSession, d: str) -> DataFrame:
    p = cubes.pool(sentences(spark, d).where("z_label is not null"), ["company", "call_id", "role", "z_label"])
    return p.select("company", "call_id", "role", "z_label", "risk_bucket", F.round("sum_s", 6).alias("sum_s"), F.round("mean_s", 9).alias("mean_s"), "n_sent")


@query(SQL + " SELECT company, z_label AS y_true, n FROM (SELECT company, z_label, count(*) AS n FROM sent WHERE z_label IS NOT NULL GROUP BY company, z_label QUALIFY row_number() OVER (PARTITION BY company ORDER BY n DESC, z_label) = 1)")
def majority_label(spark: SparkSession, d: str) -> DataFrame:
    return cubes.majority_label(sentences(spark, d), "company", "z_label").withColumnRenamed("z_label", "y_true")


FIJZ = f"fijz AS (SELECT *, ln((sum_s + a) / (o + a)) AS f_ijz FROM (SELECT *, greatest(sum(sum_s) OVER (PARTITION BY role, risk_bucket) - sum_s, 0) AS o, 1.0 * (1 + least(5.0 / greatest(n_sent, 1), 10)) AS a FROM ({pool_sql('role, z_label')})))"
SHARE = f"share AS (SELECT company, role, risk_bucket, s, n_sent, CASE WHEN total > 0 THEN s / total ELSE 0 END AS a_mij FROM (SELECT *, {_TOTAL} AS total FROM (SELECT company, role, {_SUMS}, count(*) AS n_sent FROM sent GROUP BY company, role)) UNPIVOT (s FOR risk_bucket IN ({', '.join(RISKS)})))"


def share(spark: SparkSession, d: str) -> DataFrame:
    return cubes.shares(sentences(spark, d), ["company", "role"])


def fijz(spark: SparkSession, d: str) -> DataFrame:
    return cubes.log_ratio(cubes.pool(sentences(spark, d).where("z_label is not null"), ["role", "z_label"]))


@query(SQL + f", {FIJZ} SELECT role, risk_bucket, z_label, round(f_ijz, 6) AS f_ijz, round(sum_s, 6) AS sum_s, n_sent FROM fijz")
def fijz_logratio(spark: SparkSession, d: str) -> DataFrame:
    return fijz(spark, d).select("role", "risk_bucket", "z_label", F.round("f_ijz", 6).alias("f_ijz"), F.round("sum_s", 6).alias("sum_s"), "n_sent")


PRIOR = f"weight AS (SELECT role, risk_bucket, z_label, f_ijz / {fixed.TAU} * ln(1 + greatest(n_sent, 1)) / (max(ln(1 + greatest(n_sent, 1))) OVER (PARTITION BY z_label) + 1e-6) AS w FROM fijz), prior AS (SELECT company, {', '.join(f'coalesce(sum(a_mij * w) FILTER (z_label = {z}), 0) AS prior_z{z}' for z in (1, 2, 3))} FROM share LEFT JOIN weight USING (role, risk_bucket) GROUP BY company)"


@query(SQL + f", {FIJZ}, {SHARE}, {PRIOR} SELECT company, round(prior_z1, 6) AS prior_z1, round(prior_z2, 6) AS prior_z2, round(prior_z3, 6) AS prior_z3 FROM prior")
def prior_features(spark: SparkSession, d: str) -> DataFrame:
    p = cubes.prior_features(share(spark, d), fijz(spark, d), "company")
    return p.select("company", *[F.round(f"prior_z{z}", 6).alias(f"prior_z{z}") for z in (1, 2, 3)])


PAIRS = [f"{r}|{k}" for r in ("CEO", "CFO", "Analyst", "IR", "Operator") for k in RISKS]
_WIDE = ", ".join(f"coalesce(sum(a_mij) FILTER (role || '|' || risk_bucket = '{p}'), 0) AS \"{p.replace('|', '_')}\"" for p in PAIRS)


def wide(spark: SparkSession, d: str) -> DataFrame:
    w = cubes.pivot_features(share(spark, d), "company", PAIRS)
    return w.select("company", *[F.col(f"`{p}`").alias(p.replace("|", "_")) for p in PAIRS])


@query(SQL + f", {SHARE}, w AS (SELECT company, {_WIDE} FROM share GROUP BY company) SELECT company, " + ", ".join(f'round("{p.replace("|", "_")}", 9) AS "{p.replace("|", "_")}"' for p in PAIRS) + " FROM w")
def feature_pivot(spark: SparkSession, d: str) -> DataFrame:
    return wide(spark, d).select("company", *[F.round(p.replace("|", "_"), 9).alias(p.replace("|", "_")) for p in PAIRS])


@query(SQL + f", {SHARE}, w AS (SELECT company, {_WIDE} FROM share GROUP BY company), s AS (SELECT " + ", ".join(f'stddev_pop("{p.replace("|", "_")}") AS "{p.replace("|", "_")}"' for p in PAIRS) + " FROM w) SELECT w.company, " + ", ".join(f'round(w."{c}" / CASE WHEN s."{c}" = 0 THEN 1 ELSE s."{c}" END, 6) AS "{c}"' for c in (p.replace("|", "_") for p in PAIRS)) + " FROM w, s")
def scaled_features(spark: SparkSession, d: str) -> DataFrame:
    cols = [p.replace("|", "_") for p in PAIRS]
    return cubes.scale(wide(spark, d), cols).select("company", *[F.round(c, 6).alias(c) for c in cols])


_LABELS = "lab AS (SELECT CAST(rec_no AS VARCHAR) AS rec_no, y_true FROM labels_y WHERE rec_no IS NOT NULL)"
_RANK = "r AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY md5(concat_ws('|', rec_no, '42')), rec_no) AS rank, count(*) OVER (PARTITION BY y_true) AS n FROM lab WHERE y_true IS NOT NULL)"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels_y", "rec_no", "y_true").where("rec_no is not null").withColumn("rec_no", F.col("rec_no").cast("string"))


@query(f"WITH {_LABELS}, {_RANK} SELECT rec_no, y_true, CASE WHEN rank <= greatest(1, round_even(n * 0.2, 0)) THEN 'validation' ELSE 'train' END AS split FROM r")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return cubes.stratified_split(_labels(spark, d), "y_true", "rec_no")


@query(f"WITH {_LABELS}, {_RANK} SELECT rec_no, y_true FROM r WHERE rank <= 50")
def stratified_cap(spark: SparkSession, d: str) -> DataFrame:
    return cubes.stratified_cap(_labels(spark, d).where("y_true is not null"), "y_true", "rec_no", 50)


@query(SQL + ", v AS (SELECT call_id * 100000 + sentence_id AS k, coalesce(llm_pred_prob, 0) AS p FROM sent) SELECT k, CAST(ntile(4) OVER (ORDER BY p, k) AS INT) AS quartile FROM v")
def quartile_labels(spark: SparkSession, d: str) -> DataFrame:
    v = sentences(spark, d).select((F.col("call_id") * 100000 + F.col("sentence_id")).alias("k"), F.coalesce("llm_pred_prob", F.lit(0.0)).alias("p"))
    return cubes.quartiles(v, "p", "k").select("k", "quartile")


@query("SELECT y_true, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM (SELECT y_true, count(*) AS n FROM labels_y WHERE y_true IS NOT NULL GROUP BY y_true)")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return cubes.class_weights(table(spark, d, "labels_y", "y_true"), "y_true").withColumn("weight", F.round("weight", 6))


@query("SELECT (SELECT count(DISTINCT company_id) FROM labels_y) AS n_left, (SELECT count(DISTINCT company_id) FROM preds_val_ens) AS n_right, (SELECT count(*) FROM (SELECT company_id FROM labels_y WHERE company_id IS NOT NULL INTERSECT SELECT company_id FROM preds_val_ens)) AS n_both, (SELECT count(*) FROM (SELECT company_id FROM labels_y WHERE company_id IS NOT NULL UNION SELECT company_id FROM preds_val_ens WHERE company_id IS NOT NULL)) AS n_any")
def self_check(spark: SparkSession, d: str) -> DataFrame:
    return cubes.self_check(table(spark, d, "labels_y", "company_id"), table(spark, d, "preds_val_ens", "company_id"), "company_id")


@query(SQL + " SELECT z_label, count(DISTINCT company) AS n FROM sent WHERE z_label IS NOT NULL GROUP BY ROLLUP (z_label)")
def companies_by_type(spark: SparkSession, d: str) -> DataFrame:
    return cubes.counts_by_type(sentences(spark, d), "company", "z_label")


@query("SELECT source_type, y_true, count(*) AS n FROM labels_y WHERE y_true IS NOT NULL GROUP BY source_type, y_true QUALIFY sum(n) OVER (PARTITION BY y_true) >= 5")
def minimum_class_size(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "labels_y", "source_type", "y_true").where("y_true is not null").groupBy("source_type", "y_true").agg(F.count("*").alias("n"))
    return n.withColumn("m", F.sum("n").over(Window.partitionBy("y_true"))).where("m >= 5").drop("m")
