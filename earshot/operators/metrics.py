"""Quality of three-class predictions, threshold and blend search, and the data behind the figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions import fixed

CLASSES = (1, 2, 3)


def by_class(preds: DataFrame, label: str = "y_true", prefix: str = "prob_z") -> DataFrame:
    """``z, hit, p``: one row per prediction and class."""
    rows = preds.where(F.col(label).isNotNull()).select(label, *[f"{prefix}{z}" for z in CLASSES])
    parts = F.array(*[F.struct(F.lit(z).alias("z"), (F.col(label) == z).cast("int").alias("hit"), F.coalesce(f"{prefix}{z}", F.lit(0.0)).alias("p")) for z in CLASSES])
    return rows.select(F.explode(parts).alias("r")).select("r.*")


def confusion(preds: DataFrame, label: str, predicted: str) -> DataFrame:
    """``y_true, y_pred, n``."""
    return preds.where(F.col(label).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(label).alias("y_true"), F.col(predicted).alias("y_pred")).agg(F.count("*").alias("n"))


def class_report(matrix: DataFrame) -> DataFrame:
    """``z, support, precision, recall, f1`` from a confusion matrix; 0 where undefined."""
    cell = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    parts = [F.struct(F.lit(z).alias("z"), cell((F.col("y_true") == z) & (F.col("y_pred") == z)).alias("tp"), cell(F.col("y_true") == z).alias("support"), cell(F.col("y_pred") == z).alias("predicted")) for z in CLASSES]
    r = matrix.agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, q = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return r.select("z", "support", p.alias("precision"), q.alias("recall"), ratio(2 * p * q, p + q).alias("f1"))


def report(matrix: DataFrame) -> DataFrame:
    """``n, accuracy, macro_f1`` in one row."""
    total = matrix.agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return total.crossJoin(class_report(matrix).agg(F.avg("f1").alias("macro_f1")))


def argmax_class(p: list[Column]) -> Column:
    """The class of the largest probability, the first of ties."""
    a = F.array(*p)
    return F.array_position(a, F.array_max(a)).cast("int")


def threshold_class(p: list[Column], t: list[Column]) -> Column:
    """Of the classes at or over their threshold the highest, else the largest probability."""
    return F.when(p[2] >= t[2], 3).when(p[1] >= t[1], 2).when(p[0] >= t[0], 1).otherwise(argmax_class(p))


def _cumulated(scores: DataFrame, ranges: int = 4096) -> DataFrame:
    """``z, p, pos, neg, pos_above, neg_above, pos_all, neg_all`` per distinct score, from the highest down.

    Running counts go in two levels: over a bounded number of score ranges,
    then within each range, so no task holds all scores of a class.
    """
    per = scores.groupBy("z", "p").agg(F.sum("hit").alias("pos"), F.sum(1 - F.col("hit")).alias("neg")).withColumn("range", F.floor(F.col("p") * ranges))
    above = Window.partitionBy("z").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("z")
    coarse = per.groupBy("z", "range").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"))
    coarse = coarse.select("z", "range", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("rp", "rn")], F.sum("rp").over(whole).alias("pos_all"), F.sum("rn").over(whole).alias("neg_all"))
    inner = Window.partitionBy("z", "range").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)
    out = per.join(coarse, ["z", "range"])
    return out.select("z", "p", "pos", "neg", (F.col("rp_above") + F.coalesce(F.sum("pos").over(inner), F.lit(0))).alias("pos_above"), (F.col("rn_above") + F.coalesce(F.sum("neg").over(inner), F.lit(0))).alias("neg_above"), "pos_all", "neg_all")


def auc(scores: DataFrame) -> DataFrame:
    """``z, auc``: area under the ROC curve by trapezoids, ties grouped."""
    c = _cumulated(scores)
    area = F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2)) / (F.max("pos_all") * F.max("neg_all"))
    return c.groupBy("z").agg(F.when((F.max("pos_all") > 0) & (F.max("neg_all") > 0), area).alias("auc"))


def average_precision(scores: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``z, ap``: sum of recall steps times precision, ties grouped."""
    c = _cumulated(scores)
    seen = F.col("pos_above") + F.col("pos")
    step = F.col("pos") / F.col("pos_all") * seen / (seen + F.col("neg_above") + F.col("neg"))
    return c.where("pos_all > 0").groupBy("z").agg(F.sum(step).alias("ap"))


def curve(scores: DataFrame) -> DataFrame:
    """``z, threshold, tpr, fpr, precision`` of every distinct score: points of the ROC and the precision-recall curves."""
    seen, false = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    return _cumulated(scores).select("z", F.col("p").alias("threshold"), F.try_divide(seen, "pos_all").alias("tpr"), F.try_divide(false, "neg_all").alias("fpr"), (seen / (seen + false)).alias("precision"))


def shown_class(preds: DataFrame) -> Column:
    """The class that a figure shows: by thresholds, else as predicted, else the nominal one, whichever the table has, else the largest probability."""
    have = [F.col(c).cast("int") for c in ("y_pred_thresh", "y_pred", "y_pred_nominal") if c in preds.columns]
    return have[0] if have else argmax_class([F.col(f"prob_z{z}") for z in CLASSES])


def summary(preds: DataFrame, label: str = "y_true") -> DataFrame:
    """All figures of three-class predictions in one row: accuracy and macro-F1 of the shown class, recall, average precision, AUC and Brier score of each class with their means."""
    matrix = confusion(preds.withColumn("__shown", shown_class(preds)), label, "__shown")
    out = report(matrix)
    scores = by_class(preds, label)
    for name, rows in (("recall", class_report(matrix).select("z", F.col("recall").alias("v"))), ("ap", average_precision(scores).select("z", F.col("ap").alias("v"))), ("auc", auc(scores).select("z", F.col("auc").alias("v"))), ("brier", brier(scores).select("z", F.col("brier").alias("v")))):
        # one row of each, joined by broadcast
        out = out.crossJoin(F.broadcast(rows.agg(*[F.max(F.when(F.col("z") == z, F.col("v"))).alias(f"{name}_z{z}") for z in CLASSES], F.avg("v").alias(f"macro_{name}"))))
    return out


def brier(scores: DataFrame) -> DataFrame:
    """``z, brier``."""
    return scores.groupBy("z").agg(F.avg(F.pow(F.col("p") - F.col("hit"), F.lit(2))).alias("brier"))


def _reached(grid: Column, p: Column) -> Column:
    return F.size(F.filter(grid, lambda t: p >= t))


def threshold_search(preds: DataFrame, grid: list[float] = fixed.THRESHOLDS, label: str = "y_true") -> DataFrame:
    """``t1, t2, t3, macro_f1``: the first best of all threshold triples.

    Predictions are folded to the number of thresholds each probability
    reaches, a few thousand cells however many rows there are. The grid is
    then opened one class at a time, folding after each, since the rule asks
    the classes from the highest down.
    """
    g = F.array(*[F.lit(t) for t in grid])
    p = [F.coalesce(f"prob_z{z}", F.lit(0.0)) for z in CLASSES]
    reach = [_reached(g, c) for c in p]
    cells = preds.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("y"), *[r.alias(f"k{z}") for z, r in zip(CLASSES, reach)], argmax_class(p).alias("top")).agg(F.count("*").alias("n"))
    index = F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1)))
    by3 = cells.withColumn("i3", index).withColumn("c", F.when(F.col("k3") > F.col("i3"), 3))
    by3 = by3.groupBy("i3", "y", "c", *[F.when(F.col("c").isNull(), F.col(x)).alias(x) for x in ("k1", "k2", "top")]).agg(F.sum("n").alias("n"))
    by2 = by3.withColumn("i2", index).withColumn("c", F.coalesce("c", F.when(F.col("k2") > F.col("i2"), 2)))
    by2 = by2.groupBy("i3", "i2", "y", "c", *[F.when(F.col("c").isNull(), F.col(x)).alias(x) for x in ("k1", "top")]).agg(F.sum("n").alias("n"))
    by1 = by2.withColumn("i1", index).withColumn("c", F.coalesce("c", F.when(F.col("k1") > F.col("i1"), 1), "top"))
    cell = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    f1 = [F.coalesce(F.try_divide(2 * cell((F.col("y") == z) & (F.col("c") == z)), cell(F.col("y") == z) + cell(F.col("c") == z)), F.lit(0.0)) for z in CLASSES]
    scored = by1.groupBy("i1", "i2", "i3").agg(F.round((f1[0] + f1[1] + f1[2]) / 3, 9).alias("macro_f1"))
    best = scored.orderBy(F.desc("macro_f1"), "i1", "i2", "i3").limit(1)
    return best.select(*[F.get(g, F.col(f"i{z}")).alias(f"t{z}") for z in CLASSES], "macro_f1")


def blend_search(preds: DataFrame, first: str, second: str, weights: dict[int, list[float]] | None = None, label: str = "y_true") -> DataFrame:
    """``z, weight, ap``: per class the blend of two models with the best average precision, the first of ties."""
    weights = weights or fixed.BLEND_WEIGHTS
    options = [(z, k, w) for z, ws in weights.items() for k, w in enumerate(ws)]
    rows = preds.where(F.col(label).isNotNull())
    mixed = F.array(*[F.struct(F.lit(z * 100 + k).alias("z"), (F.col(label) == z).cast("int").alias("hit"), (w * F.col(f"{first}{z}") + (1 - w) * F.col(f"{second}{z}")).alias("p")) for z, k, w in options])
    ap = average_precision(rows.select(F.explode(mixed).alias("r")).select("r.*"))
    weight = F.create_map(*[F.lit(x) for z, k, w in options for x in (z * 100 + k, w)])
    named = ap.select(F.floor(F.col("z") / 100).cast("int").alias("z"), weight[F.col("z")].alias("weight"), F.round("ap", 9).alias("ap"))
    return named.groupBy("z").agg(F.max_by(F.struct("weight", "ap"), F.struct("ap", -F.col("weight"))).alias("b")).select("z", "b.*")


def minmax(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Add ``scaled``: the value between the least and the greatest of its group, 0.5 if they agree."""
    span = rows.groupBy(group).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    joined = rows.join(span, group)
    return joined.withColumn("scaled", F.when(F.col("__hi") - F.col("__lo") <= 1e-12, 0.5).otherwise(F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo")))).drop("__lo", "__hi")


def kde(rows: DataFrame, group: str, value: str, points: int = 400, digits: int | None = 4) -> DataFrame:
    """``group, x, density`` on a grid over [0, 1]: Gaussian kernels, Silverman's bandwidth.

    With ``digits`` values are folded to so many decimals first, so the grid
    meets at most ten thousand values a group, however many rows there are;
    that moves a kernel by at most half a unit of the last decimal, a density
    by at most ``0.25 * 10 ** -digits / bandwidth ** 2``. With None nothing is
    folded and the result is exact, at one pass over the grid for each distinct value.
    """
    v = F.col(value) if digits is None else F.round(value, digits)
    folded = rows.where(F.col(value).isNotNull()).groupBy(group, v.alias("v")).agg(F.count("*").alias("n"))
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.75)), F.col("n"))
    m = folded.groupBy(group).agg(F.sum("n").alias("total"), F.sum(F.col("v") * F.col("n")).alias("s1"), F.sum(F.col("v") * F.col("v") * F.col("n")).alias("s2"), q.alias("q"))
    sd = F.sqrt(F.greatest((F.col("s2") - F.col("s1") * F.col("s1") / F.col("total")) / F.greatest(F.col("total") - 1, F.lit(1)), F.lit(0.0)))
    iqr = F.col("q")[1] - F.col("q")[0]
    sigma = F.when(iqr > 1e-12, F.least(sd, iqr / 1.349)).otherwise(sd)
    sigma = F.when(sigma <= 1e-12, F.when(sd > 1e-12, sd).otherwise(0.1)).otherwise(sigma)
    width = m.select(group, "total", F.when(F.col("total") < 2, 0.1).otherwise(F.greatest(0.9 * sigma * F.pow("total", F.lit(-0.2)), F.lit(1e-3))).alias("bw"))
    grid = folded.join(width, group).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    u = (F.col("i") / (points - 1) - F.col("v")) / F.col("bw")
    return grid.groupBy(group, "i").agg((F.sum(F.col("n") * F.exp(-0.5 * u * u)) / (F.first("total") * F.first("bw") * 2.5066282746310002)).alias("density")).select(group, (F.col("i") / (points - 1)).alias("x"), "density")
