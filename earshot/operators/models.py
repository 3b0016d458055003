"""Models on pyspark.ml: sentence classifier, and the chain from features over an ensemble to the coefficients of its surrogate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import HashingTF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.operators import metrics
from earshot.operators.cubes import class_weights, stratified_cap, stratified_split
from earshot.session import cut

CLASSES = (1, 2, 3)


def macro_f1(rows: DataFrame, label: str, predicted: str) -> float:
    """Mean F1 over the labels that occur; the cells of the confusion matrix are few."""
    cells = [tuple(r) for r in rows.groupBy(label, predicted).count().collect()]
    labels = {a for a, _, _ in cells}
    hit = {c: sum(n for a, b, n in cells if a == b == c) for c in labels}
    size = {c: sum(n for a, b, n in cells if a == c) + sum(n for a, b, n in cells if b == c) for c in labels}
    return sum(2 * hit[c] / size[c] for c in labels) / max(1, len(labels))


def text_classifier(rows: DataFrame, text: str, label: str, key: str, cap: int = 5000, weight: str | None = None, epochs: tuple[int, ...] = (5, 10, 20), held_out: float = 0.1) -> PipelineModel:
    """Multinomial logistic regression on hashed words (L2): at most ``cap`` rows of each class, optionally weighted.

    Of the numbers of passes in ``epochs`` the one with the best macro-F1 on
    the held-out share is taken, the first of ties.
    """
    sample = stratified_cap(rows.where(F.col(text).isNotNull() & F.col(label).isNotNull()), label, key, cap)
    sample = cut(sample.join(stratified_split(sample, label, key, held_out).select(key, "split"), key))
    words = [RegexTokenizer(inputCol=text, outputCol="__words", pattern="[^a-z]+"), HashingTF(inputCol="__words", outputCol="__features", numFeatures=1 << 14)]
    train, held = sample.where("split = 'train'"), sample.where("split = 'validation'")
    best, top = None, -1.0
    for n in epochs:
        model = LogisticRegression(featuresCol="__features", labelCol=label, family="multinomial", regParam=0.01, maxIter=n, **({"weightCol": weight} if weight else {}))
        fitted = Pipeline(stages=[*words, model]).fit(train)
        if (f1 := macro_f1(fitted.transform(held), label, "prediction")) > top:
            best, top = fitted, f1
    return best


def apply_classifier(model: PipelineModel, rows: DataFrame, classes: int) -> DataFrame:
    """Rows with ``prediction`` and one probability column per class (L3)."""
    out = model.transform(rows).withColumn("__p", vector_to_array("probability"))
    return out.select(*rows.columns, "prediction", *[F.get("__p", F.lit(k)).alias(f"p{k}") for k in range(classes)])


def assembled(features: DataFrame, columns: list[str]) -> DataFrame:
    quoted = {c: f"__x{k}" for k, c in enumerate(columns)}  # names with dots or bars
    plain = features.withColumns({q: F.col(f"`{c}`").cast("double") for c, q in quoted.items()})
    return VectorAssembler(inputCols=list(quoted.values()), outputCol="features").transform(plain).drop(*quoted.values())


def weighted(rows: DataFrame, label: str) -> DataFrame:
    """Add ``class_weight``; one row a class is broadcast."""
    return rows.join(F.broadcast(class_weights(rows, label).select(label, F.col("weight").alias("class_weight"))), label)


def _probabilities(model, rows: DataFrame, prefix: str, classes: tuple[int, ...] = CLASSES) -> DataFrame:
    """Rows with a probability column per class; labels of the model count from 0."""
    p = vector_to_array("probability")
    out = model.transform(rows)
    return out.select(*rows.columns, *[F.coalesce(F.get(p, F.lit(z - 1)), F.lit(0.0)).alias(f"{prefix}{z}") for z in classes])


def forest(train: DataFrame, held: DataFrame, label: str, sizes: tuple[int, ...] = (10, 20, 40, 80), seed: int = 42):
    """Random forest with class weights; it grows until the macro-F1 on the held-out rows no longer rises (L4)."""
    rows, best, top = weighted(train, label), None, -1.0
    for n in sizes:
        model = RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="class_weight", numTrees=n, maxDepth=6, minInstancesPerNode=2, seed=seed).fit(rows)
        f1 = macro_f1(model.transform(held), label, "prediction")
        if f1 <= top:
            break
        best, top = model, f1
    return best


def boosted(train: DataFrame, label: str, key: str, holdout: float = 0.1, seed: int = 42) -> dict:
    """One boosted-tree model a class against the rest; each stops by its loss on an inner holdout of the training rows."""
    inner = stratified_split(train, label, key, holdout, seed=seed + 1).select(key, (F.col("split") == "validation").alias("inner"))
    rows = cut(weighted(train, label).join(inner, key))
    models = {}
    for z in CLASSES:
        one = rows.withColumn("is_class", (F.col(label) == z - 1).cast("double"))
        models[z] = GBTClassifier(featuresCol="features", labelCol="is_class", weightCol="class_weight", maxIter=30, maxDepth=3, stepSize=0.1, validationIndicatorCol="inner", validationTol=0.001, seed=seed).fit(one)
    return models


def boosted_probabilities(models: dict, rows: DataFrame, prefix: str) -> DataFrame:
    """Rows with a probability column per class: the scores against the rest over their sum."""
    keep, out = rows.columns, rows
    for z, model in models.items():
        out = model.transform(out).withColumn(f"__p{z}", F.get(vector_to_array("probability"), F.lit(1))).drop("rawPrediction", "probability", "prediction")
    total = sum((F.col(f"__p{z}") for z in models), F.lit(0.0))
    return out.select(*keep, *[F.try_divide(F.col(f"__p{z}"), total).alias(f"{prefix}{z}") for z in CLASSES])


def surrogate(train: DataFrame, label: str):
    """Multinomial logistic regression with class weights on unscaled features; the penalty is half the squared norm against the summed loss."""
    n = max(1, train.count())
    return LogisticRegression(featuresCol="features", labelCol=label, weightCol="class_weight", family="multinomial", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=200).fit(weighted(train, label))


def coefficients(model, columns: list[str], classes: list[int], spark) -> DataFrame:
    """``z_label, feature, coef`` of a surrogate: as many rows as features and classes."""
    m = model.coefficientMatrix.toArray()
    return spark.createDataFrame([(z, c, float(m[k][j])) for k, z in enumerate(classes) for j, c in enumerate(columns)], "z_label int, feature string, coef double")


@dataclass
class Outcome:
    """``predictions``: key, y_true, split, ensemble probabilities ``prob_z1..3``, ``y_pred`` by the thresholds, ``z_star`` by the largest,
    ``y_surrogate`` and its probabilities ``lin_z1..3``; ``coefficients`` of the surrogate; the blend and thresholds found."""

    predictions: DataFrame
    coefficients: DataFrame
    blend: dict[int, float]
    thresholds: tuple[float, ...]


def outcome_model(features: DataFrame, columns: list[str], key: str, label: str) -> Outcome:
    """The chain from features to coefficients.

    A fifth of each class is held out. A forest and boosted trees are fitted to
    the rest; per class they are blended by average precision, then thresholds
    are searched, both on the held-out rows; the surrogate is fitted to the
    decisions of the ensemble over all rows. If a class has too few training
    rows for the boosted trees the forest stands alone. ``label`` is 1, 2 or 3;
    rows without one are left out.
    """
    rows = assembled(features.where(F.col(label).isNotNull()), columns).select(key, "features", (F.col(label) - 1).cast("double").alias("label"))
    rows = cut(rows.join(stratified_split(rows, "label", key).select(key, "split"), key))
    train, held = rows.where("split = 'train'"), rows.where("split = 'validation'")
    first = forest(train, held, "label")
    preds = _probabilities(first, rows, "first_z")
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    blend = {z: 1.0 for z in CLASSES}
    if len(counts) == len(CLASSES) and min(counts.values()) >= 3:
        preds = cut(boosted_probabilities(boosted(train, "label", key), preds, "second_z"))
        judged = preds.where("split = 'validation'").withColumn("y_true", F.col("label") + 1)
        blend |= {r["z"]: r["weight"] for r in metrics.blend_search(judged, "first_z", "second_z").collect()}
    else:
        preds = preds.withColumns({f"second_z{z}": F.lit(0.0) for z in CLASSES})
    mixed = {f"prob_z{z}": blend[z] * F.col(f"first_z{z}") + (1 - blend[z]) * F.col(f"second_z{z}") for z in CLASSES}
    preds = cut(preds.select(key, "features", "split", (F.col("label") + 1).cast("int").alias("y_true"), *[c.alias(n) for n, c in mixed.items()]))
    t = metrics.threshold_search(preds.where("split = 'validation'")).first()
    limits = tuple(t[f"t{z}"] for z in CLASSES) if t else (0.5, 0.5, 0.5)
    p = [F.col(f"prob_z{z}") for z in CLASSES]
    preds = preds.withColumn("y_pred", metrics.threshold_class(p, [F.lit(x) for x in limits])).withColumn("z_star", metrics.argmax_class(p))
    decided = preds.withColumn("decided", (F.col("z_star") - 1).cast("double"))
    linear = surrogate(decided, "decided")
    out = _probabilities(linear, preds, "lin_z").withColumn("y_surrogate", metrics.argmax_class([F.col(f"lin_z{z}") for z in CLASSES])).drop("features")
    classes = list(range(1, linear.numClasses + 1))
    return Outcome(cut(out), coefficients(linear, columns, classes, features.sparkSession), blend, limits)
