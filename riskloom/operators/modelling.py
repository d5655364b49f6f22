"""Draws, folds, feature vectors and classifiers over labelled tables.

Draws are functions of a row's id and a seed, so reruns, retries and other partitionings agree.  Classifiers are Spark's own,
trained on the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import actions, urls
from riskloom.operators import profile

_STEPS = 1 << 20


def uniform(id_: Column, seed: int) -> Column:
    """A number from 0 to 1, 1 excluded, in 2**20 steps; null ids get one of their own."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("long") / float(_STEPS)


def chosen(id_: Column, weights: dict[str, float], seed: int) -> Column:
    """K1: one of the names, by weight."""
    if not weights or min(weights.values()) < 0 or sum(weights.values()) <= 0:
        raise ValueError("weights must be non-negative, and one of them positive")
    u, upto, names = uniform(id_, seed) * sum(weights.values()), 0.0, list(weights)
    out = None
    for name in names[:-1]:
        upto += weights[name]
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def masked(value: Column, id_: Column, share: float, seed: int) -> Column:
    """The value, null for a share of the ids."""
    return F.when(uniform(id_, seed) >= share, value)


def folds(df: DataFrame, label: str, id_: str, n: int = 5, seed: int = 42) -> DataFrame:
    """K3: adds ``fold`` from 0; the folds of a label differ by one row at most."""
    return profile.ranked(df, label, id_, seed).withColumn("fold", ((F.col("__rank") - 1) % n).cast("long")).drop("__rank", "__size")


def group_holdout(group: Column, share: float, seed: int = 42) -> Column:
    """K4: whether a whole group is held out."""
    return uniform(group, seed) < share


def matched(controls: DataFrame, cases: DataFrame, id_: str, seed: int = 42) -> DataFrame:
    """As many controls as there are cases, in order of a hash; a global rank would gather all, so ranks are kept by block of the hash."""
    blocks = 4096
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_).cast("string")))
    rows = controls.withColumn("__h", digest).withColumn("__b", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    sizes = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))  # at most ``blocks`` rows
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__b", "__before")
    assert blocks == 16**3
    wanted = cases.agg(F.count(F.lit(1)).alias("__wanted"))
    ranked = rows.join(F.broadcast(before), "__b").join(F.broadcast(wanted)).where("__before < __wanted").withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__h", id_)))
    return ranked.where(F.col("__before") + F.col("__r") <= F.col("__wanted")).select(*controls.columns)


def one_hot(value: Column, vocabulary: list[str], prefix: str) -> dict[str, Column]:
    """A column for each known value, 1.0 where it is met; all 0 for null and unknown values."""
    v = F.coalesce(F.trim(value.cast("string")), F.lit(""))
    return {f"{prefix}_{name}": F.when(v == name, 1.0).otherwise(0.0) for name in vocabulary}


def vector(columns: dict[str, Column], order: list[str]) -> Column:
    """Array of floats in the order given; absent, null and unreadable ones are 0, others are left out."""
    return F.array(*[F.coalesce(columns[n].try_cast("float"), F.lit(0.0).cast("float")) if n in columns else F.lit(0.0).cast("float") for n in order])


def labelled_by(probability: Column, threshold: float = 0.5) -> Column:
    """H19."""
    return F.when(probability >= threshold, 1).when(probability.isNotNull(), 0)


def pipeline(numbers: list[str], names: list[str], classifier, label: str = "label"):
    """K5: medians for missing numbers, standardised; names by index and one-hot, unknown ones apart; then the classifier."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler

    filled = [f"{c}__filled" for c in numbers]
    stages = [
        Imputer(strategy="median", inputCols=numbers, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__numbers"), StandardScaler(withMean=True, inputCol="__numbers", outputCol="__scaled"),
        *([StringIndexer(inputCols=names, outputCols=[f"{c}__index" for c in names], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}__index" for c in names], outputCols=[f"{c}__hot" for c in names])] if names else []),
        VectorAssembler(inputCols=["__scaled", *[f"{c}__hot" for c in names]], outputCol="features"), classifier.copy().setParams(featuresCol="features", labelCol=label),
    ]
    return Pipeline(stages=stages)


def classifiers(seed: int = 42) -> dict:
    """K6: the kinds of classifier that Spark has."""
    from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier

    return {"random_forest": RandomForestClassifier(numTrees=50, maxDepth=8, seed=seed), "boosted_trees": GBTClassifier(maxIter=30, maxDepth=5, seed=seed), "logistic_regression": LogisticRegression(maxIter=100), "linear_svm": LinearSVC(maxIter=100)}


def best(train: DataFrame, test: DataFrame, numbers: list[str], names: list[str], kinds: dict, label: str = "label"):
    """K9 and T4: (name, fitted pipeline, areas under the curve by name, greatest first); ties go to the first by name."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    judge = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")
    fitted = {k: pipeline(numbers, names, c, label).fit(train) for k, c in kinds.items()}
    areas = sorted(((k, judge.evaluate(m.transform(test))) for k, m in fitted.items()), key=lambda a: (-a[1], a[0]))
    return areas[0][0], fitted[areas[0][0]], dict(areas)


def searched(train: DataFrame, numbers: list[str], names: list[str], classifier, grid: dict, label: str = "label", n: int = 3, seed: int = 42):
    """K7: the best of all settings by cross-validated F1."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    whole = pipeline(numbers, names, classifier, label)
    last = whole.getStages()[-1]
    build = ParamGridBuilder()
    for name, values in grid.items():
        build = build.addGrid(last.getParam(name), values)
    return CrossValidator(estimator=whole, estimatorParamMaps=build.build(), evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="f1"), numFolds=n, seed=seed).fit(train)


def importances(model, data: DataFrame, most: int = 20) -> list[tuple[str, float]]:
    """The features of a fitted tree pipeline by importance, greatest first, ties by name; at most as many as the model has."""
    attrs = model.transform(data.limit(0)).schema["features"].metadata["ml_attr"]["attrs"]
    named = [(a.get("name", str(a["idx"])), float(model.stages[-1].featureImportances[a["idx"]])) for group in attrs.values() for a in group]
    return sorted(named, key=lambda f: (-f[1], f[0]))[:most]


def known_columns(df: DataFrame, wanted: list[str], dropped: list[str] = ()) -> tuple[DataFrame, list[str]]:
    """The wanted columns that exist, in that order, each once and without the dropped ones; and the names that don't exist."""
    once = list(dict.fromkeys(wanted))
    return df.select(*[F.col(f"`{c}`") for c in once if c in df.columns and c not in dropped]), [c for c in once if c not in df.columns]


def clean_names(names: list[str]) -> list[str]:
    """anything but letters, digits and _ becomes _; of names that become equal, later ones get a number."""
    out: list[str] = []
    for n in names:
        clean = "".join(c if c.isascii() and c.isalnum() or c == "_" else "_" for c in n)
        out.append(clean if clean not in out else next(f"{clean}_{k}" for k in range(1, len(names) + 1) if f"{clean}_{k}" not in out))
    return out


def encoded_alike(train: DataFrame, test: DataFrame, name: str, vocabulary: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both parts get the same columns for a name, from one vocabulary; what only the test rows have is no column."""
    hot = lambda df: df.withColumns(one_hot(F.col(name), vocabulary, name)).drop(name)
    return hot(train), hot(test)


def mismatches(page_url: Column, form_action: Column, official: Column) -> dict[str, Column]:
    """True, false or null (not known): whether the page, and where its form leads, lie outside the brand's domain."""
    to = urls.host(actions.resolved_action(page_url, F.coalesce(form_action, F.lit(""))))
    known = official.isNotNull()
    return {
        "brand_domain_known": known, "page_brand_domain_mismatch": F.when(known, ~actions.belongs(urls.host(page_url), official)),
        "form_action_brand_domain_mismatch": F.when(known & (F.coalesce(to, F.lit("")) != ""), ~actions.belongs(to, official)),
    }


def saved(model, path: str) -> None:
    """K9: writes a fitted pipeline; ``PipelineModel.load`` reads it."""
    model.write().overwrite().save(path)
