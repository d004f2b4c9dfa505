"""Models by catalogue name: Spark ML pipelines over named feature columns.

A fitted model is a ``Fitted``: the saved pipeline, the feature names, the class labels in index order.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier, OneVsRestModel)
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from millrace.plans.counting import num
from millrace.plans.hashing import hash_numbered
from millrace.plans.lineage import cut

# fixed values: the catalogue's default parameters
DEFAULTS = {
    "logistic_regression": {"C": 1.0, "max_iter": 1000},
    "random_forest": {"n_estimators": 200, "max_depth": None},
    "gradient_boosting": {"n_estimators": 200, "learning_rate": 0.1, "max_depth": 3},
    "xgboost": {"n_estimators": 200, "learning_rate": 0.1, "max_depth": 6},
    "lightgbm": {"n_estimators": 200, "learning_rate": 0.05, "max_depth": 5},
    "catboost": {"n_estimators": 200, "learning_rate": 0.05, "max_depth": 6},
    "svm_rbf": {"C": 1.0, "components": 64},
    "naive_bayes": {},
    "mlp": {"hidden": [100, 50], "max_iter": 300},
    "adaboost": {"n_estimators": 100, "learning_rate": 0.5},
    "linear_regression": {},
    "ridge": {"alpha": 1.0},
    "lasso": {"alpha": 1.0, "max_iter": 1000},
    "elastic_net": {"alpha": 1.0, "l1_ratio": 0.5, "max_iter": 1000},
    "kmeans": {"k": 8},
    "hierarchical": {"k": 8},
}
#: fixed values: further parameters of the catalogue, by model
FURTHER = {
    "logistic_regression": {"solver"},
    "random_forest": {"min_samples_leaf", "min_samples_split", "max_features"},
    **dict.fromkeys(("gradient_boosting", "xgboost", "lightgbm", "catboost"), {"min_samples_leaf", "min_samples_split", "max_features", "subsample"}),
}
BOOSTED = ("gradient_boosting", "xgboost", "lightgbm", "catboost")
REGRESSORS = ("linear_regression", "ridge", "lasso", "elastic_net")
UNLIMITED_DEPTH = 30  # Spark trees need a limit; this is its largest


@dataclass
class Fitted:
    model: PipelineModel
    name: str
    task: str
    features: list[str]
    labels: list[str] = field(default_factory=list)
    params: dict = field(default_factory=dict)


def checked_params(name: str, params: dict) -> dict:
    """The model's parameters with its defaults filled in. A name that the catalogue's model does not have is an error."""
    if name not in DEFAULTS:
        raise ValueError(f"unknown model {name!r}")
    unknown = set(params) - set(DEFAULTS[name]) - FURTHER.get(name, set()) - {"weight_col"}
    if unknown:
        raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    return {**DEFAULTS[name], **params}


def _tree_params(p: dict) -> dict:
    """Spark's names for what a tree model was given. The solver of a linear model, in contrast, changes only the way to the same optimum."""
    out = {}
    if p.get("min_samples_leaf") is not None:
        if isinstance(p["min_samples_leaf"], float):
            raise ValueError("min_samples_leaf is a number of rows")
        out["minInstancesPerNode"] = int(p["min_samples_leaf"])
    if p.get("min_samples_split") not in (None, 2):
        raise ValueError("Spark's trees have no min_samples_split: use min_samples_leaf")
    if "max_features" in p:
        f = p["max_features"]
        if isinstance(f, str) and f not in ("sqrt", "log2", "auto"):
            raise ValueError("max_features is sqrt, log2, a share, a number or None")
        out["featureSubsetStrategy"] = "all" if f is None or f == 1.0 and isinstance(f, float) else str(f)
    if p.get("subsample") is not None:
        out["subsamplingRate"] = float(p["subsample"])
    return out


def estimator(name: str, task: str, rows: int, classes: int, width: int, params: dict,
              label_sd: float = 1.0):
    """The Spark estimator for a catalogue name with translated parameters."""
    p = checked_params(name, params)
    trees = _tree_params(p)
    cls = {"featuresCol": "_features", "labelCol": "_label"}
    if params.get("weight_col"):
        cls["weightCol"] = params["weight_col"]
    depth = p.get("max_depth") or UNLIMITED_DEPTH
    if name == "logistic_regression":
        return LogisticRegression(**cls, maxIter=p["max_iter"], regParam=1.0 / (p["C"] * max(rows, 1)), standardization=False)
    if name == "random_forest":
        forest = RandomForestClassifier if task == "classification" else RandomForestRegressor
        return forest(**cls, numTrees=p["n_estimators"], maxDepth=depth, seed=42, **trees)
    if name in BOOSTED:
        if task == "regression":
            return GBTRegressor(**cls, maxIter=p["n_estimators"], stepSize=p["learning_rate"], maxDepth=depth, seed=42, **trees)
        gbt = GBTClassifier(**cls, maxIter=p["n_estimators"], stepSize=p["learning_rate"], maxDepth=depth, seed=42, **trees)
        return gbt if classes == 2 else OneVsRest(classifier=gbt, featuresCol="_features", labelCol="_label")
    if name == "svm_rbf":
        svc = LinearSVC(**cls, maxIter=100, regParam=1.0 / (p["C"] * max(rows, 1)), standardization=False)
        return svc if classes == 2 else OneVsRest(classifier=svc, featuresCol="_features", labelCol="_label")
    if name == "naive_bayes":
        return NaiveBayes(**cls, modelType="gaussian")
    if name == "mlp":
        return MultilayerPerceptronClassifier(featuresCol="_features", labelCol="_label", maxIter=p["max_iter"],
                                              layers=[width, *p["hidden"], classes], seed=42)
    if name in REGRESSORS:
        # Spark scales the label to unit deviation, which divides its L2 term (not the L1 term) by that
        # deviation; ridge's alpha also stands against the summed, not the mean, squared error
        alpha, l1 = p.get("alpha", 0.0), {"lasso": 1.0, "elastic_net": p.get("l1_ratio", 0.5)}.get(name, 0.0)
        l2 = (alpha / max(rows, 1) if name == "ridge" else alpha) * (1 - l1) * label_sd
        reg = alpha * l1 + l2
        mix = alpha * l1 / reg if reg else 0.0
        return LinearRegression(**cls, regParam=reg, elasticNetParam=mix, maxIter=p.get("max_iter", 1000), standardization=False)
    raise ValueError(f"unknown model {name!r}")


def _fourier(df: DataFrame, features: list[str], components: int, seed: int = 42) -> tuple[list, list[str]]:
    """Pipeline stages for random Fourier features of the RBF kernel with gamma = 1 / (d · variance)."""
    row = df.agg(*[f(num(c)) for c in features for f in (F.avg, F.avg)],
                 *[F.avg(num(c) * num(c)) for c in features]).first()
    d = len(features)
    mean = sum(row[2 * i] for i in range(d)) / d
    var = sum(row[2 * d + i] for i in range(d)) / d - mean * mean
    gamma = 1.0 / (d * var) if var > 0 else 1.0 / d
    rng = random.Random(seed)
    w = [[rng.gauss(0, math.sqrt(2 * gamma)) for _ in features] for _ in range(components)]
    b = [rng.uniform(0, 2 * math.pi) for _ in range(components)]
    x = "array(" + ", ".join(f"cast(`{c}` as double)" for c in features) + ")"
    rows = "array(" + ", ".join("struct(array(" + ", ".join(f"{v!r}D" for v in wi) + f") as w, {bi!r}D as b)" for wi, bi in zip(w, b)) + ")"
    scale = math.sqrt(2.0 / components)
    z = (f"transform({rows}, r -> {scale!r}D * cos(r.b + aggregate(zip_with(r.w, {x}, (p, q) -> p * q), 0D, (s, v) -> s + v)))")
    names = [f"_z{i}" for i in range(components)]
    first = SQLTransformer(statement=f"SELECT *, {z} AS _z FROM __THIS__")
    second = SQLTransformer(statement="SELECT *, " + ", ".join(f"_z[{i}] AS {n}" for i, n in enumerate(names)) + " FROM __THIS__")
    return [first, second], names


def fit(df: DataFrame, name: str, features: list[str], target: str, task: str = "classification", params: dict | None = None) -> Fitted:
    """Fit on rows with a target. Classes are indexed in sorted order. Feature nulls are an error: clean first.

    The columns that take part are written once: counting, indexing and every pass of the estimator read those.
    """
    params = params or {}
    used = list(dict.fromkeys([*features, target, *([params["weight_col"]] if params.get("weight_col") else [])]))
    data = cut(df.dropna(subset=[target]).select(*used))
    rows = data.count()
    stages, labels, sd = [], [], 1.0
    if task == "classification":
        labels = sorted(r[0] for r in data.select(F.col(target).cast("string")).distinct().limit(1001).collect())
        if len(labels) > 1000:
            raise ValueError(f"{target} has more than 1000 classes")
        stages.append(StringIndexer(inputCol="_target", outputCol="_label", stringOrderType="alphabetAsc"))
        data = data.withColumn("_target", F.col(target).cast("string"))
    else:
        data = data.withColumn("_label", num(target))
        if name in REGRESSORS:
            sd = data.agg(F.stddev_pop("_label")).first()[0] or 1.0
    names = features
    if name == "svm_rbf":
        extra, names = _fourier(data, features, {**DEFAULTS[name], **params}["components"])
        stages += extra
    assembler = VectorAssembler(inputCols=names, outputCol="_features")
    if name == "adaboost":
        return _fit_adaboost(data, features, labels, stages, assembler, {**DEFAULTS[name], **params})
    stages += [assembler, estimator(name, task, rows, len(labels), len(names), params, sd)]
    fitted = Pipeline(stages=stages).fit(data)
    # the label indexer is only for fitting; scoring frames need not have the target
    kept = [s for s in fitted.stages if not type(s).__name__.startswith("StringIndexer")]
    return Fitted(PipelineModel(kept), name, task, features, labels, params)


class Boosted:
    """AdaBoost (SAMME) stumps with their weights."""

    def __init__(self, assembler, models, alphas, classes):
        self.assembler, self.models, self.alphas, self.classes = assembler, models, alphas, classes

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.assembler.transform(df)
        votes = [F.lit(0.0)] * self.classes
        for i, (m, a) in enumerate(zip(self.models, self.alphas)):
            m = m.copy({m.predictionCol: f"_p{i}", m.probabilityCol: f"_q{i}", m.rawPredictionCol: f"_r{i}"})
            out = m.transform(out).drop(f"_q{i}", f"_r{i}")
            votes = [v + F.when(F.col(f"_p{i}") == k, F.lit(a)).otherwise(0.0) for k, v in enumerate(votes)]
        total = sum(self.alphas) or 1.0
        out = out.withColumn("probability", F.array(*[v / total for v in votes])).drop(*[f"_p{i}" for i in range(len(self.models))])
        return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))


def _fit_adaboost(data: DataFrame, features, labels, stages, assembler, p) -> Fitted:
    """Multiclass AdaBoost: each round fits a weighted stump and raises the weight of its misses."""
    k, lr = len(labels), p["learning_rate"]
    for s in stages:
        data = s.fit(data).transform(data)
    work = cut(assembler.transform(data).select("_features", "_label").withColumn("_w", F.lit(1.0)))
    models, alphas = [], []
    for i in range(p["n_estimators"]):
        stump = DecisionTreeClassifier(featuresCol="_features", labelCol="_label", weightCol="_w", maxDepth=1, seed=42).fit(work)
        scored = stump.transform(work)
        miss = F.col("prediction") != F.col("_label")
        err = scored.agg(F.sum(F.when(miss, F.col("_w")).otherwise(0.0)) / F.sum("_w")).first()[0]
        if err >= 1 - 1 / k:
            break
        alpha = lr * (math.log((1 - err) / max(err, 1e-10)) + math.log(k - 1))
        models.append(stump)
        alphas.append(alpha)
        if err <= 1e-10:
            break
        work = scored.withColumn("_w", F.col("_w") * F.when(miss, math.exp(alpha)).otherwise(1.0)).select("_features", "_label", "_w")
        if i % 5 == 4:
            work = cut(work)
    return Fitted(Boosted(assembler, models, alphas, k), "adaboost", "classification", features, labels, p)


def probabilities(f: Fitted, scored: DataFrame) -> Column:
    """array<double> of class probabilities; a margin goes through the logistic function."""
    if "probability" in scored.columns:
        return F.col("probability") if isinstance(f.model, Boosted) else vector_to_array("probability")
    if "rawPrediction" in scored.columns and len(f.labels) == 2:
        p = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
        return F.array(1 - p, p)
    return F.array(*[(F.col("prediction") == i).cast("double") for i in range(len(f.labels))])


def predict(f: Fitted, df: DataFrame, keep: list[str], threshold: float = 0.5, raw: bool = False,
            proba: bool = True, with_features: bool = False, like: DataFrame | None = None) -> DataFrame:
    """``keep`` columns, the prediction and, for classes, ``proba_{class}`` columns. Lazy: no action runs.

    The decision threshold applies to two-class models. Predictions are labels; ``raw`` keeps class indices.
    ``like`` aligns the features to a training frame first.
    """
    if like is not None:
        from millrace.operators.split import align
        rest = [c for c in keep if c not in f.features]
        df = align(df, df.select(*rest).limit(0).select(*rest, *[F.lit(0.0).alias(c) for c in f.features]))
    scored = f.model.transform(df)
    carried = list(dict.fromkeys([*keep, *(f.features if with_features else [])]))
    if f.task == "regression":
        return scored.select(*carried, "prediction")
    p = probabilities(f, scored)
    index = F.when(p[1] >= threshold, 1).otherwise(0) if len(f.labels) == 2 else F.col("prediction").cast("int")
    label = F.get(F.array(*[F.lit(x) for x in f.labels]), index)
    cols = [p[i].alias(f"proba_{x}") for i, x in enumerate(f.labels)] if proba else []
    return scored.select(*carried, (index if raw else label).alias("prediction"), *cols)


def preview_predictions(f: Fitted, df: DataFrame, keep: list[str], n: int = 50) -> DataFrame:
    """The limit comes before the model runs."""
    return predict(f, df.limit(n), keep)


# clustering -------------------------------------------------------------------------------------------

def cluster(df: DataFrame, name: str, features: list[str], k: int = 8, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """K-Means, or bisecting K-Means as the hierarchical method; adds ``cluster``."""
    est = (KMeans if name == "kmeans" else BisectingKMeans)(featuresCol="_features", predictionCol="cluster", k=k, seed=seed)
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), est]).fit(df)
    return model, model.transform(df)


def silhouette(clustered: DataFrame) -> float:
    """Mean silhouette with squared Euclidean distance."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    return ClusteringEvaluator(featuresCol="_features", predictionCol="cluster").evaluate(clustered)


# explanation ------------------------------------------------------------------------------------------

def importance(f: Fitted, top: int = 20) -> DataFrame:
    """(feature, importance), largest first: tree importances, or mean absolute coefficients."""
    from pyspark.sql import SparkSession
    if isinstance(f.model, Boosted):
        total = sum(f.model.alphas) or 1.0
        values = sum(a / total * m.featureImportances.toArray() for m, a in zip(f.model.models, f.model.alphas))
        rows = sorted(zip(f.features, map(float, values)), key=lambda t: (-t[1], t[0]))[:top]
        return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")
    last = f.model.stages[-1]
    if isinstance(last, OneVsRestModel):   # the mean over the classes' models
        values = sum(m.featureImportances.toArray() if hasattr(m, "featureImportances") else abs(m.coefficients.toArray()) for m in last.models) / len(last.models)
    elif hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficientMatrix"):
        values = abs(last.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(last, "coefficients"):
        values = abs(last.coefficients.toArray())
    else:
        raise ValueError(f"{f.name} has no importances")
    rows = sorted(zip(f.features, map(float, values)), key=lambda t: (-t[1], t[0]))[:top]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")


def output_value(f: Fitted, scored: DataFrame) -> Column:
    return F.col("prediction") if f.task == "regression" else probabilities(f, scored)[1]


def permutation_importance(f: Fitted, df: DataFrame, target: str, keys: list[str], seed: int = 42) -> DataFrame:
    """(feature, drop): loss of accuracy (or R²) when one feature is exchanged between rows.

    Rows are paired through two hash orders, so the exchange is a plain equi-join on position.
    """
    from millrace.operators import metrics
    from millrace.plans.hashing import hash_numbered

    def score(frame):
        out = predict(f, frame, [target], proba=False)
        if f.task == "classification":
            return metrics.accuracy(out.withColumn("_y", F.col(target).cast("string")), "_y", "prediction").first()[0]
        return metrics.regression_scores(out, target, "prediction").first()["r2"]

    base = score(df)
    here = cut(hash_numbered(df, keys, seed, "_i"))
    there = cut(hash_numbered(df.select(*keys, *f.features), keys, seed + 1, "_i"))
    rows = []
    for c in f.features:
        mixed = here.drop(c).join(there.select("_i", c), "_i")
        rows.append((c, base - score(mixed)))
    return df.sparkSession.createDataFrame(rows, "feature string, drop double")


PART_ROWS = 250_000   # pairs of a row and a permutation that a task scores


def shapley(f: Fitted, rows: DataFrame, background: DataFrame, key: str, permutations: int = 20) -> DataFrame:
    """(key, feature, value): Monte-Carlo Shapley values of every row given.

    Each row goes through ``permutations`` seeded feature orders; in each, features switch one by one from
    a background row to the row's own value. Background rows (``key`` unique there too) are numbered in hash order; a
    (row, permutation) draws a number and meets that row in an equi-join, so every complete background row can be drawn. The
    work is rows × permutations × (features + 1) model scores, all in one plan. The join, which also
    scores, is dealt into parts of bounded size, whatever the number of shuffle partitions.
    """
    d = len(f.features)
    pool = background.select(F.col(key).alias("_k"), F.array(*[num(c) for c in f.features]).alias("_b")).filter(~F.exists("_b", lambda v: v.isNull()))
    pool = cut(pool)
    total = pool.count()
    pool = hash_numbered(pool, ["_k"], 17, "_at", rows=total).drop("_k")
    draw = lambda *xs: F.conv(F.substring(F.md5(F.concat_ws("#", *xs)), 1, 8), 16, 10).cast("long")
    x = cut(rows.select(F.col(key), F.array(*[num(c) for c in f.features]).alias("_x")))
    parts = -(-x.count() * permutations // PART_ROWS)
    many = max(parts, x.sparkSession.sparkContext.defaultParallelism)
    x = x.withColumn("_m", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    x = x.withColumn("_at", draw(F.col(key).cast("string"), F.col("_m").cast("string")) % F.lit(max(total, 1)) + 1)
    if parts > 1 and total > 100 * many:   # a smaller background is left to a broadcast
        x, pool = x.repartition(many, "_at"), pool.repartition(many, "_at")
    x = x.join(pool, "_at").drop("_at")
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: F.struct(
        F.md5(F.concat_ws("#", F.col(key).cast("string"), F.col("_m").cast("string"), j.cast("string"))).alias("h"), j.alias("j"))))
    x = x.withColumn("_o", F.transform(order, lambda s: s["j"])).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(d))))
    mixed = {c: F.when(F.array_position("_o", F.lit(j)) <= F.col("_s"), F.col("_x")[j]).otherwise(F.col("_b")[j])
             for j, c in enumerate(f.features)}
    scored = f.model.transform(x.withColumns(mixed))
    val = output_value(f, scored)
    steps = F.array(F.struct(F.get("_o", F.col("_s") - 1).alias("j"), val.alias("v")), F.struct(F.get("_o", F.col("_s")).alias("j"), (-val).alias("v")))
    names = F.array(*[F.lit(c) for c in f.features])
    steps = scored.select(key, F.explode(steps).alias("p")).filter("p.j is not null").select(key, "p.j", "p.v")
    return (steps.groupBy(key, "j").agg((F.sum("v") / permutations).alias("value"))
            .select(key, F.get(names, F.col("j")).alias("feature"), "value"))
