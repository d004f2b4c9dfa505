"""Search, cross-validation, model comparison and learning curves on hash-ordered folds."""

from __future__ import annotations

import itertools
import random
import statistics
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, functions as F

from millrace.operators import metrics, models
from millrace.operators.split import folds
from millrace.plans.hashing import hash_unit
from millrace.plans.lineage import cut

# fixed values: search ranges by model; ("uniform", loc, scale), ("randint", low, high) or a list
SPACES = {
    "logistic_regression": {"C": ("uniform", 0.01, 10), "max_iter": [500, 1000, 2000]},
    "random_forest": {"n_estimators": ("randint", 50, 400), "max_depth": [None, 5, 10, 15, 20]},
    "gradient_boosting": {"n_estimators": ("randint", 50, 400), "learning_rate": ("uniform", 0.01, 0.3), "max_depth": ("randint", 3, 10)},
    "xgboost": {"n_estimators": ("randint", 50, 400), "learning_rate": ("uniform", 0.01, 0.3), "max_depth": ("randint", 3, 10)},
    "lightgbm": {"n_estimators": ("randint", 50, 400), "learning_rate": ("uniform", 0.01, 0.3), "max_depth": [5, 10, 15]},
    "catboost": {"n_estimators": ("randint", 50, 400), "learning_rate": ("uniform", 0.01, 0.3), "max_depth": ("randint", 3, 10)},
    "ridge": {"alpha": ("uniform", 0.001, 100)},
    "lasso": {"alpha": ("uniform", 0.001, 10), "max_iter": [1000, 2000, 5000]},
    "elastic_net": {"alpha": ("uniform", 0.001, 10), "l1_ratio": ("uniform", 0.05, 0.9)},
    "svm_rbf": {"C": ("uniform", 0.01, 100)},
    "mlp": {"hidden": [[50], [100], [100, 50], [100, 100], [200, 100]]},
    "adaboost": {"n_estimators": ("randint", 30, 200), "learning_rate": ("uniform", 0.01, 1.5)},
}
SCORINGS = ("roc_auc", "f1", "f1_macro", "f1_weighted", "accuracy", "precision", "recall", "r2",
            "neg_mean_absolute_error", "neg_mean_squared_error", "neg_root_mean_squared_error")


def default_scoring(task: str, subtask: str) -> str:
    if task == "classification":
        return "roc_auc" if subtask == "binary" else "f1_macro"
    return "r2"


def draw_params(space: dict, n: int, seed: int = 42) -> list[dict]:
    """``n`` random parameter sets; a space of lists only is never drawn more often than it has sets."""
    rng = random.Random(seed)
    lists_only = all(isinstance(v, list) for v in space.values())
    if lists_only:
        every = grid_params(space)
        return rng.sample(every, min(n, len(every)))
    out = []
    for _ in range(n):
        one = {}
        for k, v in space.items():
            if isinstance(v, list):
                one[k] = rng.choice(v)
            elif v[0] == "uniform":
                one[k] = v[1] + rng.random() * v[2]
            else:
                one[k] = rng.randrange(v[1], v[2])
        out.append(one)
    return out


def grid_params(space: dict[str, list]) -> list[dict]:
    return [dict(zip(space, c)) for c in itertools.product(*space.values())]


def score(f: models.Fitted, df: DataFrame, target: str, scoring: str) -> float:
    """One of the scoring names on a frame; every one is a single aggregation. Larger is better."""
    if scoring not in SCORINGS:
        raise ValueError(f"unknown scoring {scoring!r}")
    out = models.predict(f, df.dropna(subset=[target]), [target])
    if f.task == "regression":
        m = metrics.regression_scores(out, target, "prediction").first()
        return {"r2": m["r2"], "neg_mean_absolute_error": -m["mae"], "neg_mean_squared_error": -m["mse"],
                "neg_root_mean_squared_error": -m["rmse"]}[scoring]
    out = out.withColumn("_y", F.col(target).cast("string"))
    if scoring == "roc_auc":
        return metrics.roc_auc(out, "_y", f"proba_{f.labels[1]}", f.labels[1]).first()[0]
    if scoring == "accuracy":
        return metrics.accuracy(out, "_y", "prediction").first()[0]
    if scoring in ("f1", "precision", "recall"):
        return metrics.binary_scores(out, "_y", "prediction", f.labels[1]).first()[scoring]
    return metrics.averages(metrics.class_report(out, "_y", "prediction")).first()[scoring]


def cross_validate(df: DataFrame, name: str, features: list[str], target: str, task: str, params: dict, scoring: str,
                   k: int, fold: str = "fold") -> list[float]:
    """Score per fold. ``df`` carries the fold column."""
    out = []
    for i in range(k):
        f = models.fit(df.filter(F.col(fold) != i), name, features, target, task, params)
        out.append(score(f, df.filter(F.col(fold) == i), target, scoring))
    return out


def search(df: DataFrame, name: str, features: list[str], target: str, keys: list[str], task: str = "classification",
           scoring: str | None = None, space: dict | None = None, method: str = "random", n_iter: int = 20, k: int = 5,
           parallelism: int = 4, top: int = 20) -> tuple[models.Fitted, DataFrame, DataFrame]:
    """(best model refitted on all rows, table of the best configurations, original-versus-tuned row).

    Folds are stratified for classification. Configurations run as concurrent jobs.
    """
    scoring = scoring or default_scoring(task, "binary")
    cols = list(dict.fromkeys([*keys, *features, target]))
    data = cut(folds(df.select(*cols).dropna(subset=[target]), keys, k, target if task == "classification" else None))
    space = space or SPACES[name]
    sets = grid_params(space) if method == "grid" else draw_params(space, n_iter)

    def run(p):
        return cross_validate(data, name, features, target, task, p, scoring, k)

    with ThreadPoolExecutor(parallelism) as pool:
        scores = list(pool.map(run, [{}, *sets]))
    original, tuned = scores[0], scores[1:]
    order = sorted(range(len(sets)), key=lambda i: -statistics.fmean(tuned[i]))
    spark = df.sparkSession
    rows = [(r + 1, str(sets[i]), statistics.fmean(tuned[i]), statistics.pstdev(tuned[i])) for r, i in enumerate(order[:top])]
    table = spark.createDataFrame(rows, "rank int, params string, mean double, std double")
    best = statistics.fmean(tuned[order[0]])
    gain = spark.createDataFrame([(name, scoring, statistics.fmean(original), best, best - statistics.fmean(original))],
                                 "model string, scoring string, original double, tuned double, gain double")
    return models.fit(data, name, features, target, task, sets[order[0]]), table, gain


def compare(df: DataFrame, candidates: dict[str, dict], features: list[str], target: str, keys: list[str],
            task: str = "classification", scoring: str | None = None, k: int = 5) -> DataFrame:
    """(model, mean, std, min, max), best first; ``candidates`` maps a model name to its parameters."""
    scoring = scoring or default_scoring(task, "binary")
    data = cut(folds(df.select(*dict.fromkeys([*keys, *features, target])).dropna(subset=[target]), keys, k,
                     target if task == "classification" else None))
    rows = []
    for name, params in candidates.items():
        s = cross_validate(data, name, features, target, task, params, scoring, k)
        rows.append((name, statistics.fmean(s), statistics.pstdev(s), min(s), max(s)))
    return df.sparkSession.createDataFrame(rows, "model string, mean double, std double, min double, max double").orderBy(F.desc("mean"), "model")


def pick_best(df: DataFrame, table: DataFrame, candidates: dict[str, dict], features: list[str], target: str,
              task: str = "classification", manual: str | None = None) -> models.Fitted:
    """The best model of a comparison (or the one named) refitted on all rows."""
    name = manual or table.orderBy(F.desc("mean"), "model").first()["model"]
    return models.fit(df, name, features, target, task, candidates[name])


def learning_curve(df: DataFrame, name: str, features: list[str], target: str, keys: list[str], task: str = "classification",
                   params: dict | None = None, points: int = 6, k: int = 3, max_rows: int | None = None, max_trees: int | None = None) -> DataFrame:
    """(rows, train_mean, train_std, val_mean, val_std) for growing shares of each training fold.

    Prefixes are hash thresholds, so each size contains the smaller ones. ``max_trees`` optionally limits forests.
    ``max_rows`` optionally thins the frame first (by hash threshold).
    """
    params = dict(params or {})
    if max_trees and name in ("random_forest", *models.BOOSTED):
        params["n_estimators"] = min(params.get("n_estimators", models.DEFAULTS[name]["n_estimators"]), max_trees)
    data = df.select(*dict.fromkeys([*keys, *features, target])).dropna(subset=[target])
    if max_rows:
        n = data.count()
        data = data if n <= max_rows else data.filter(hash_unit(keys, 7) < max_rows / n)
    data = cut(folds(data, keys, k, target if task == "classification" else None).withColumn("_u", hash_unit(keys, 11)))
    scoring = "accuracy" if task == "classification" else "r2"
    rows = []
    for j in range(points):
        share = 0.1 + 0.9 * j / (points - 1)
        train_s, val_s, size = [], [], []
        for i in range(k):
            part = data.filter((F.col("fold") != i) & (F.col("_u") < share))
            f = models.fit(part, name, features, target, task, params)
            size.append(part.count())
            train_s.append(score(f, part, target, scoring))
            val_s.append(score(f, data.filter(F.col("fold") == i), target, scoring))
        rows.append((round(statistics.fmean(size)), statistics.fmean(train_s), statistics.pstdev(train_s),
                     statistics.fmean(val_s), statistics.pstdev(val_s)))
    return df.sparkSession.createDataFrame(rows, "rows long, train_mean double, train_std double, val_mean double, val_std double")
