"""Metric, model and attribution queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import fixed
from earshot.operators import attribution, common, cubes, metrics, models
from earshot.plans.base import RISKS, SQL, sentences
from earshot.plans.cube_queries import FIJZ, PAIRS, SHARE, fijz, share
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


def _preds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "preds_val_ens")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.by_class(_preds(spark, d))


_LONG = "long AS (" + " UNION ALL ".join(f"SELECT {z} AS z, CAST(y_true = {z} AS INT) AS hit, coalesce(prob_z{z}, 0) AS p FROM preds_val_ens WHERE y_true IS NOT NULL" for z in (1, 2, 3)) + ")"
_CUM = _LONG + """, per AS (SELECT z, p, sum(hit)::BIGINT AS pos, sum(1 - hit)::BIGINT AS neg FROM long GROUP BY z, p),
cum AS (SELECT *, sum(pos) OVER w - pos AS pos_above, sum(neg) OVER w - neg AS neg_above, sum(pos) OVER (PARTITION BY z) AS pos_all, sum(neg) OVER (PARTITION BY z) AS neg_all FROM per WINDOW w AS (PARTITION BY z ORDER BY p DESC))"""
_MATRIX = "m AS (SELECT y_true, y_pred, count(*) AS n FROM preds_val_ens WHERE y_true IS NOT NULL AND y_pred IS NOT NULL GROUP BY ALL)"
_REPORT = _MATRIX + ", k AS (SELECT z, coalesce(sum(n) FILTER (y_true = z AND y_pred = z), 0) AS tp, coalesce(sum(n) FILTER (y_true = z), 0)::BIGINT AS support, coalesce(sum(n) FILTER (y_pred = z), 0) AS predicted FROM m, (SELECT unnest([1, 2, 3]) AS z) GROUP BY z)"


@query(f"WITH {_MATRIX} SELECT * FROM m")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(_preds(spark, d), "y_true", "y_pred")


@query(f"WITH {_REPORT} SELECT (SELECT sum(n)::BIGINT FROM m) AS n, round((SELECT sum(n) FROM m WHERE y_true = y_pred) / (SELECT sum(n) FROM m), 9) AS accuracy, round(avg(coalesce(2 * tp / nullif(support + predicted, 0), 0)), 9) AS macro_f1 FROM k")
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.report(metrics.confusion(_preds(spark, d), "y_true", "y_pred"))
    return r.select("n", F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


@query(f"WITH {_REPORT} SELECT z, support, round(coalesce(tp / nullif(predicted, 0), 0), 9) AS precision, round(coalesce(tp / nullif(support, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(support + predicted, 0), 0), 9) AS f1 FROM k")
def recall_per_class(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.class_report(metrics.confusion(_preds(spark, d), "y_true", "y_pred"))
    return r.select("z", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_LONG} SELECT z, round(avg(pow(p - hit, 2)), 9) AS brier FROM long GROUP BY z")
def brier_per_class(spark: SparkSession, d: str) -> DataFrame:
    return metrics.brier(_scores(spark, d)).select("z", F.round("brier", 9).alias("brier"))


@query(f"WITH {_CUM} SELECT z, round(sum(neg * (pos_above + pos / 2)) / (max(pos_all) * max(neg_all)), 9) AS auc FROM cum GROUP BY z")
def auc_ovr(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auc(_scores(spark, d)).select("z", F.round("auc", 9).alias("auc"))


@query(f"WITH {_CUM} SELECT z, round(sum(pos / pos_all * (pos_above + pos) / (pos_above + pos + neg_above + neg)), 9) AS ap FROM cum GROUP BY z")
def average_precision_ovr(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(_scores(spark, d)).select("z", F.round("ap", 9).alias("ap"))


@query(f"WITH {_CUM} SELECT z, p AS threshold, round((pos_above + pos) / pos_all, 9) AS tpr, round((neg_above + neg) / neg_all, 9) AS fpr, round((pos_above + pos) / (pos_above + pos + neg_above + neg), 9) AS precision FROM cum")
def roc_pr_points(spark: SparkSession, d: str) -> DataFrame:
    return metrics.curve(_scores(spark, d)).select("z", "threshold", *[F.round(c, 9).alias(c) for c in ("tpr", "fpr", "precision")])


_ROW = lambda name, source, digits=9: ", ".join(f"round(max({name}) FILTER (z = {z}), {digits}) AS {name}_z{z}" for z in (1, 2, 3)) + f", round(avg({name}), {digits}) AS macro_{name} FROM {source}"


@query(f"""WITH RECURSIVE {_REPORT}, {_CUM}, rc AS (SELECT z, coalesce(tp / nullif(support, 0), 0) AS recall FROM k), br AS (SELECT z, avg(pow(p - hit, 2)) AS brier FROM long GROUP BY z),
au AS (SELECT z, sum(neg * (pos_above + pos / 2)) / (max(pos_all) * max(neg_all)) AS auc FROM cum GROUP BY z), pr AS (SELECT z, sum(pos / pos_all * (pos_above + pos) / (pos_above + pos + neg_above + neg)) AS ap FROM cum GROUP BY z),
re AS (SELECT (SELECT sum(n)::BIGINT FROM m) AS n, round((SELECT sum(n) FROM m WHERE y_true = y_pred) / (SELECT sum(n) FROM m), 9) AS accuracy, round(avg(coalesce(2 * tp / nullif(support + predicted, 0), 0)), 9) AS macro_f1 FROM k)
SELECT * FROM re, (SELECT {_ROW('recall', 'rc')}), (SELECT {_ROW('ap', 'pr')}), (SELECT {_ROW('auc', 'au')}), (SELECT {_ROW('brier', 'br')})""")
def metrics_row(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.summary(_preds(spark, d))
    return r.select("n", *[F.round(c, 9).alias(c) for c in r.columns if c != "n"])


_TOP = "CASE WHEN prob_z1 >= prob_z2 AND prob_z1 >= prob_z3 THEN 1 WHEN prob_z2 >= prob_z3 THEN 2 ELSE 3 END"


@query(f"SELECT rec_no, CASE WHEN prob_z3 >= 0.55 THEN 3 WHEN prob_z2 >= 0.6 THEN 2 WHEN prob_z1 >= 0.25 THEN 1 ELSE {_TOP} END AS y_thresh, {_TOP} AS y_top FROM preds_val_ens")
def threshold_classes(spark: SparkSession, d: str) -> DataFrame:
    p = [F.col(f"prob_z{z}") for z in (1, 2, 3)]
    return _preds(spark, d).select("rec_no", metrics.threshold_class(p, [F.lit(0.25), F.lit(0.6), F.lit(0.55)]).alias("y_thresh"), metrics.argmax_class(p).alias("y_top"))


_GRID = ", ".join(str(t) for t in fixed.THRESHOLDS)


@query(f"""WITH g AS (SELECT a.t AS t1, b.t AS t2, c.t AS t3 FROM (SELECT unnest([{_GRID}])::DOUBLE AS t) a, (SELECT unnest([{_GRID}])::DOUBLE AS t) b, (SELECT unnest([{_GRID}])::DOUBLE AS t) c),
p AS (SELECT y_true AS y, prob_z1, prob_z2, prob_z3, {_TOP} AS top FROM preds_val_ens WHERE y_true IS NOT NULL),
s AS (SELECT t1, t2, t3, y, CASE WHEN prob_z3 >= t3 THEN 3 WHEN prob_z2 >= t2 THEN 2 WHEN prob_z1 >= t1 THEN 1 ELSE top END AS c FROM p, g),
f AS (SELECT t1, t2, t3, round((coalesce(2 * count(*) FILTER (y = 1 AND c = 1) / nullif(count(*) FILTER (y = 1) + count(*) FILTER (c = 1), 0), 0) + coalesce(2 * count(*) FILTER (y = 2 AND c = 2) / nullif(count(*) FILTER (y = 2) + count(*) FILTER (c = 2), 0), 0) + coalesce(2 * count(*) FILTER (y = 3 AND c = 3) / nullif(count(*) FILTER (y = 3) + count(*) FILTER (c = 3), 0), 0)) / 3, 9) AS macro_f1 FROM s GROUP BY ALL)
SELECT * FROM f ORDER BY macro_f1 DESC, t1, t2, t3 LIMIT 1""")
def threshold_search(spark: SparkSession, d: str) -> DataFrame:
    return metrics.threshold_search(_preds(spark, d))


_OPTIONS = ", ".join(f"({z}, {w}::DOUBLE)" for z, ws in fixed.BLEND_WEIGHTS.items() for w in ws)


@query(f"""WITH o AS (SELECT * FROM (VALUES {_OPTIONS}) v(z, weight)), x AS (SELECT z, weight, CAST(y_true = z AS INT) AS hit, weight * CASE z WHEN 1 THEN prob_z1 WHEN 2 THEN prob_z2 ELSE prob_z3 END + (1 - weight) * CASE WHEN y_pred = z THEN 0.8 ELSE 0.1 END AS p FROM preds_val_ens, o WHERE y_true IS NOT NULL),
per AS (SELECT z, weight, p, sum(hit) AS pos, sum(1 - hit) AS neg FROM x GROUP BY z, weight, p), c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY z, weight) AS pa FROM per WINDOW w AS (PARTITION BY z, weight ORDER BY p DESC)),
a AS (SELECT z, weight, round(sum(pos / pa * cp / (cp + cn)), 9) AS ap FROM c GROUP BY z, weight) SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY z ORDER BY ap DESC, weight) = 1""")
def blend_search(spark: SparkSession, d: str) -> DataFrame:
    second = {f"second_z{z}": F.when(F.col("y_pred") == z, 0.8).otherwise(0.1) for z in (1, 2, 3)}
    return metrics.blend_search(_preds(spark, d).withColumns(second), "prob_z", "second_z")


_MEANS = "v AS (SELECT y_pred AS model, z, avg(CASE z WHEN 1 THEN prob_z1 WHEN 2 THEN prob_z2 ELSE prob_z3 END) AS value FROM preds_val_ens, (SELECT unnest([1, 2, 3]) AS z) WHERE y_pred IS NOT NULL GROUP BY y_pred, z)"


@query(f"WITH {_MEANS} SELECT model, z, round(CASE WHEN max(value) OVER w - min(value) OVER w <= 1e-12 THEN 0.5 ELSE (value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0) END, 9) AS scaled FROM v WINDOW w AS (PARTITION BY z)")
def minmax_compare(spark: SparkSession, d: str) -> DataFrame:
    means = _preds(spark, d).where("y_pred is not null").groupBy(F.col("y_pred").alias("model")).agg(*[F.avg(f"prob_z{z}").alias(str(z)) for z in (1, 2, 3)])
    long = means.unpivot("model", ["1", "2", "3"], "z", "value").withColumn("z", F.col("z").cast("int"))
    return metrics.minmax(long, "z", "value").select("model", "z", F.round("scaled", 9).alias("scaled"))


_CONF = "SELECT y_true, greatest(prob_z1, prob_z2, prob_z3) AS conf FROM preds_val_ens WHERE y_true IS NOT NULL"


@query(f"""WITH f AS (SELECT y_true, conf AS v FROM ({_CONF})), m AS (SELECT y_true, count(*) AS total, stddev_samp(v) AS sd, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM f GROUP BY y_true),
g AS (SELECT *, CASE WHEN iqr > 1e-12 THEN least(sd, iqr / 1.349) ELSE sd END AS sigma FROM m),
b AS (SELECT *, CASE WHEN total < 2 THEN 0.1 ELSE greatest(0.9 * CASE WHEN sigma <= 1e-12 THEN CASE WHEN sd > 1e-12 THEN sd ELSE 0.1 END ELSE sigma END * pow(total, -0.2), 1e-3) END AS bw FROM g)
SELECT y_true, round(i / 399, 9) AS x, round(sum(exp(-0.5 * pow((i / 399 - v) / bw, 2))) / (any_value(total) * any_value(bw) * sqrt(2 * pi())), 6) AS density FROM f JOIN b USING (y_true), range(0, 400) t(i) GROUP BY y_true, i""")
def confidence_kde(spark: SparkSession, d: str) -> DataFrame:
    conf = _preds(spark, d).where("y_true is not null").select("y_true", F.greatest("prob_z1", "prob_z2", "prob_z3").alias("conf"))
    return metrics.kde(conf, "y_true", "conf", digits=None).select("y_true", F.round("x", 9).alias("x"), F.round("density", 6).alias("density"))


@query(f"SELECT y_true, round(quantile_cont(conf, 0.25), 9) AS q25, round(quantile_cont(conf, 0.5), 9) AS q50, round(quantile_cont(conf, 0.75), 9) AS q75 FROM ({_CONF}) GROUP BY y_true")
def confidence_quartiles(spark: SparkSession, d: str) -> DataFrame:
    conf = _preds(spark, d).where("y_true is not null").select("y_true", F.greatest("prob_z1", "prob_z2", "prob_z3").alias("conf"))
    return conf.groupBy("y_true").agg(*[F.round(F.percentile("conf", q), 9).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)])


# -- models (no SQL: fitted)
@query()
def risk_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Cause of each sentence told from its text; sentences far from risk weigh less in the fit."""
    s = sentences(spark, d)
    best = F.greatest(*[f"prob_{r}" for r in RISKS])
    label = F.when(F.col(f"prob_{RISKS[0]}") == best, 0.0).when(F.col(f"prob_{RISKS[1]}") == best, 1.0).when(F.col(f"prob_{RISKS[2]}") == best, 2.0).otherwise(3.0)
    weight = common.sample_weight(common.risk_distance(None, [], [F.col("llm_pred_prob")]))
    rows = s.select("call_id", "sentence_id", F.concat_ws("-", "call_id", "sentence_id").alias("key"), F.coalesce("sentence_text", F.lit("")).alias("sentence_text"), label.alias("label"), weight.alias("weight"))
    model = models.text_classifier(rows, "sentence_text", "label", "key", cap=2000, weight="weight")
    return models.apply_classifier(model, rows.select("call_id", "sentence_id", "sentence_text"), 4)


def _outcome(spark: SparkSession, d: str) -> models.Outcome:
    """Shares by role and cause and the priors of each company against its majority type."""
    s = cut(share(spark, d))
    pairs = cubes.pivot_features(s, "company", PAIRS).join(cubes.prior_features(s, fijz(spark, d), "company"), "company")
    y = cubes.majority_label(sentences(spark, d), "company", "z_label").select("company", F.col("z_label").alias("y_true"))
    return models.outcome_model(pairs.join(y, "company"), [*PAIRS, *[f"prior_z{z}" for z in (1, 2, 3)]], "company", "y_true")


@query()
def tree_ensemble(spark: SparkSession, d: str) -> DataFrame:
    return _outcome(spark, d).predictions


@query()
def surrogate_logit(spark: SparkSession, d: str) -> DataFrame:
    return _outcome(spark, d).coefficients


@query()
def outcome_report(spark: SparkSession, d: str) -> DataFrame:
    """Figures of the fitted chain by split: the ensemble's arg-max and thresholded classes, and how far the surrogate agrees with it."""
    p = _outcome(spark, d).predictions
    parts = []
    for split in ("train", "validation"):
        rows = p.where(F.col("split") == split)
        for kind, c in (("largest", "z_star"), ("thresholds", "y_pred"), ("surrogate", "y_surrogate")):
            parts.append(metrics.report(metrics.confusion(rows, "z_star" if kind == "surrogate" else "y_true", c)).select(F.lit(split).alias("split"), F.lit(kind).alias("rule"), "n", "accuracy", "macro_f1"))
    return reduce(lambda a, b: a.union(b), parts)


@query()
def fitted_prob_contrib(spark: SparkSession, d: str) -> DataFrame:
    """Features, ensemble, surrogate, coefficients, contributions in one chain: the ten largest of each company at the type decided for it."""
    o = _outcome(spark, d)
    units = attribution.coefficient_units(cut(fijz(spark, d)), o.coefficients)
    c = attribution.logit_contributions(share(spark, d), units, "company")
    p = o.predictions.select("company", "z_star", *[F.col(f"lin_z{z}").alias(str(z)) for z in (1, 2, 3)])
    long = p.unpivot(["company", "z_star"], ["1", "2", "3"], "z_label", "p").withColumn("z_label", F.col("z_label").cast("int"))
    c = attribution.prob_contributions(c, long.drop("z_star"), "company")
    return attribution.top_k(attribution.at_star(c, p.select("company", "z_star"), "company"), "company", "c_prob").select("company", "role", "risk_bucket", "z_label", "c_logit", "c_prob", "rank")


# -- attribution over given coefficients, so that SQL can follow; the fitted ones go through the same operators in fitted_prob_contrib
def _beta(f: DataFrame) -> DataFrame:
    return f.where("z_label is not null").select("role", "risk_bucket", "z_label", (F.col("f_ijz") / 10 + F.col("z_label") / 100).alias("coef"))


def _gamma(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(z, 0.01 * z, 0.02 * z, 0.03 * z) for z in (1, 2, 3)], "z_label int, g1 double, g2 double, g3 double")


def units(spark: SparkSession, d: str) -> DataFrame:
    f = cut(fijz(spark, d))  # roles x causes x types, read several times
    return attribution.unit_logits(f, _beta(f), _gamma(spark))


UNITS = FIJZ + """, beta AS (SELECT role, risk_bucket, z_label, f_ijz / 10 + z_label / 100 AS coef FROM fijz),
units AS (SELECT p.role, p.risk_bucket, z.z AS z_label, coalesce(b.coef, 0) + 0.01 * z.z * coalesce(f1, 0) + 0.02 * z.z * coalesce(f2, 0) + 0.03 * z.z * coalesce(f3, 0) AS unit_logit
 FROM (SELECT role, risk_bucket, max(f_ijz) FILTER (z_label = 1) AS f1, max(f_ijz) FILTER (z_label = 2) AS f2, max(f_ijz) FILTER (z_label = 3) AS f3 FROM fijz GROUP BY ALL) p CROSS JOIN (SELECT unnest([1, 2, 3]) AS z) z
 LEFT JOIN beta b ON p.role = b.role AND p.risk_bucket = b.risk_bucket AND z.z = b.z_label)"""
PM = "pm AS (SELECT trim(split_part(company_id, ',', 1)) AS company_id, z AS z_label, avg(CASE z WHEN 1 THEN prob_z1 WHEN 2 THEN prob_z2 ELSE prob_z3 END) AS p FROM preds_val_ens, (SELECT unnest([1, 2, 3]) AS z) WHERE company_id IS NOT NULL GROUP BY ALL)"
CONTRIB = SHARE + ", cs AS (SELECT trim(split_part(company, ',', 1)) AS company_id, role, risk_bucket, sum(a_mij) AS a_mij FROM share GROUP BY ALL), cl AS (SELECT company_id, cs.role, cs.risk_bucket, z_label, a_mij, a_mij * unit_logit AS c_logit FROM cs JOIN units u ON cs.role = u.role AND cs.risk_bucket = u.risk_bucket)"
PROB = CONTRIB + f", {PM}, cp AS (SELECT cl.*, c_logit - avg(c_logit) OVER (PARTITION BY role, risk_bucket, cl.z_label) AS delta, coalesce(p, 0) AS p FROM cl LEFT JOIN pm ON cl.company_id = pm.company_id AND cl.z_label = pm.z_label), c AS (SELECT *, p * (1 - p) * delta AS c_prob FROM cp)"


def probs(spark: SparkSession, d: str) -> DataFrame:
    means = _preds(spark, d).where("company_id is not null").groupBy(F.trim(F.substring_index("company_id", ",", 1)).alias("company_id")).agg(*[F.avg(f"prob_z{z}").alias(str(z)) for z in (1, 2, 3)])
    return means.unpivot("company_id", ["1", "2", "3"], "z_label", "p").withColumn("z_label", F.col("z_label").cast("int"))


def contributions(spark: SparkSession, d: str) -> DataFrame:
    s = share(spark, d).groupBy(F.trim(F.substring_index("company", ",", 1)).alias("company_id"), "role", "risk_bucket").agg(F.sum("a_mij").alias("a_mij"))
    return attribution.logit_contributions(s, units(spark, d), "company_id")


def prob_contributions(spark: SparkSession, d: str) -> DataFrame:
    return attribution.prob_contributions(contributions(spark, d), probs(spark, d), "company_id")


@query(SQL + f", {UNITS} SELECT role, risk_bucket, z_label, round(unit_logit, 6) + 0.0 AS unit_logit FROM units")
def unit_logit(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).select("role", "risk_bucket", "z_label", (F.round("unit_logit", 6) + 0.0).alias("unit_logit"))


@query(SQL + f", {UNITS}, {CONTRIB} SELECT company_id, role, risk_bucket, z_label, round(a_mij, 9) AS a_mij, round(c_logit, 6) + 0.0 AS c_logit FROM cl")
def logit_contrib(spark: SparkSession, d: str) -> DataFrame:
    return contributions(spark, d).select("company_id", "role", "risk_bucket", "z_label", F.round("a_mij", 9).alias("a_mij"), (F.round("c_logit", 6) + 0.0).alias("c_logit"))


@query(SQL + f", {UNITS}, {PROB} SELECT company_id, role, risk_bucket, z_label, round(delta, 6) + 0.0 AS delta, round(c_prob, 6) + 0.0 AS c_prob FROM c")
def prob_contrib(spark: SparkSession, d: str) -> DataFrame:
    return prob_contributions(spark, d).select("company_id", "role", "risk_bucket", "z_label", (F.round("delta", 6) + 0.0).alias("delta"), (F.round("c_prob", 6) + 0.0).alias("c_prob"))


@query(SQL + f", {UNITS}, {PROB}, r AS (SELECT *, round(c_prob, 9) AS v FROM c) SELECT company_id, role, risk_bucket, z_label, CAST(row_number() OVER (PARTITION BY company_id ORDER BY abs(v) DESC, role, risk_bucket, z_label) AS INT) AS rank FROM r QUALIFY rank <= 10")
def topk_per_company(spark: SparkSession, d: str) -> DataFrame:
    rows = prob_contributions(spark, d).withColumn("v", F.round("c_prob", 9))
    return attribution.top_k(rows, "company_id", "v").select("company_id", "role", "risk_bucket", "z_label", "rank")


_STAR = ", star AS (SELECT company_id, z_label AS z_star FROM pm WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY p DESC, z_label) = 1)"


@query(SQL + f", {UNITS}, {PROB}{_STAR}, r AS (SELECT c.*, round(c_prob, 9) AS v FROM c JOIN star s ON c.company_id = s.company_id AND c.z_label = s.z_star) SELECT company_id, role, risk_bucket, z_label, CAST(row_number() OVER (PARTITION BY company_id ORDER BY abs(v) DESC, role, risk_bucket, z_label) AS INT) AS rank FROM r QUALIFY rank <= 10")
def topk_star(spark: SparkSession, d: str) -> DataFrame:
    rows = attribution.at_star(prob_contributions(spark, d), attribution.star(probs(spark, d), "company_id"), "company_id").withColumn("v", F.round("c_prob", 9))
    return attribution.top_k(rows, "company_id", "v").select("company_id", "role", "risk_bucket", "z_label", "rank")


@query(SQL + f", {UNITS}, {CONTRIB}, w AS (SELECT z_label, company_id, role || '|' || risk_bucket AS winner FROM cl QUALIFY row_number() OVER (PARTITION BY z_label, company_id ORDER BY round(a_mij, 12) DESC, role || '|' || risk_bucket) = 1) SELECT z_label, winner, count(*) AS n, sum(count(*)) OVER (PARTITION BY z_label)::BIGINT AS total FROM w GROUP BY z_label, winner")
def winner_share_amij(spark: SparkSession, d: str) -> DataFrame:
    """The pairs that win on the share itself instead of its contribution."""
    rows = contributions(spark, d).select("z_label", "company_id", F.concat_ws("|", "role", "risk_bucket").alias("pair"), "a_mij")
    return attribution.winner_share(attribution.winners(rows, "company_id", "pair", "a_mij")).select("z_label", "winner", "n", "total")


@query(SQL + f", {UNITS}, {PROB} SELECT company_id, role, risk_bucket, z_label, round(sum(c_logit), 6) + 0.0 AS c_logit, round(sum(c_prob), 6) + 0.0 AS c_prob FROM c GROUP BY GROUPING SETS ((company_id, role, z_label), (company_id, risk_bucket, z_label))")
def agg_role_risk(spark: SparkSession, d: str) -> DataFrame:
    return attribution.roll_ups(prob_contributions(spark, d), "company_id").select("company_id", "role", "risk_bucket", "z_label", (F.round("c_logit", 6) + 0.0).alias("c_logit"), (F.round("c_prob", 6) + 0.0).alias("c_prob"))


_WON = ", won AS (SELECT z_label, company_id, pair AS winner FROM (SELECT z_label, company_id, role || '|' || risk_bucket AS pair, round(sum(c_prob), 9) AS s FROM c GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY z_label, company_id ORDER BY s DESC, pair) = 1), ws AS (SELECT z_label, winner, count(*) AS n FROM won GROUP BY ALL)"


def _won(spark: SparkSession, d: str) -> DataFrame:
    rows = prob_contributions(spark, d).select("z_label", "company_id", F.concat_ws("|", "role", "risk_bucket").alias("pair"), F.round("c_prob", 9).alias("c_prob"))
    return attribution.winners(rows, "company_id", "pair")


@query(SQL + f", {UNITS}, {PROB}{_WON.replace('round(sum(c_prob), 9)', 'round(sum(round(c_prob, 9)), 12)')} SELECT z_label, winner, n, sum(n) OVER (PARTITION BY z_label)::BIGINT AS total, round(n / sum(n) OVER (PARTITION BY z_label), 9) AS share FROM ws")
def winner_share(spark: SparkSession, d: str) -> DataFrame:
    return attribution.winner_share(_won(spark, d)).withColumn("share", F.round("share", 9))


@query(SQL + f", {UNITS}, {PROB} SELECT company_id, role, risk_bucket, z_label, round(CASE WHEN max(CAST(c_prob > 0 AS INT)) OVER w = 1 THEN greatest(c_prob, 0) / greatest(sum(greatest(c_prob, 0)) OVER w, 1e-9) ELSE abs(c_prob) / greatest(sum(abs(c_prob)) OVER w, 1e-9) END, 6) AS share FROM c WINDOW w AS (PARTITION BY company_id, z_label)")
def pair_share(spark: SparkSession, d: str) -> DataFrame:
    return attribution.positive_share(prob_contributions(spark, d), "company_id", "c_prob").select("company_id", "role", "risk_bucket", "z_label", F.round("share", 6).alias("share"))


@query("WITH k AS (SELECT source_type, count(*) FILTER (y_true = 1) AS k, count(*) AS n FROM labels_y GROUP BY source_type), w AS (SELECT *, k / n AS p, 1 + 3.8416 / n AS den FROM k) SELECT source_type, round((p + 3.8416 / (2 * n)) / den, 9) AS centre, round(greatest((p + 3.8416 / (2 * n)) / den - 1.96 / den * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n), 0), 9) AS low, round(least((p + 3.8416 / (2 * n)) / den + 1.96 / den * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n), 1), 9) AS high FROM w")
def wilson_interval(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "labels_y", "source_type", "y_true").groupBy("source_type").agg(F.count_if(F.col("y_true") == 1).alias("k"), F.count("*").alias("n"))
    return k.select("source_type", *[F.round(c, 9).alias(n) for n, c in attribution.wilson(F.col("k"), F.col("n")).items()])
