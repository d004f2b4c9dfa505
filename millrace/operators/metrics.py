"""Evaluation as plain aggregations over a prediction table (y, y_hat, p).

Everything a metric needs is a count per (label, prediction) or per distinct score, combined on the map
side. Undefined ratios are 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.charts import histogram
from millrace.plans.counting import num
from millrace.plans.ordering import running_totals

EPS = 2.220446049250313e-16  # fixed value: machine epsilon of a double


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """(y, y_hat, n)"""
    return df.groupBy(F.col(y).alias("y"), F.col(y_hat).alias("y_hat")).agg(F.count(F.lit(1)).alias("n"))


def confusion_wide(df: DataFrame, classes: list, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    return df.groupBy(F.col(y).alias("y")).pivot(y_hat, classes).count().fillna(0)


def accuracy(df: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(y_hat)).cast("double")).alias("accuracy"))


def binary_scores(df: DataFrame, y: str = "y", y_hat: str = "y_hat", positive=1) -> DataFrame:
    """(precision, recall, f1) of one class."""
    t, p = F.col(y) == F.lit(positive), F.col(y_hat) == F.lit(positive)
    s = df.agg(F.sum((t & p).cast("long")).alias("tp"), F.sum(p.cast("long")).alias("pp"), F.sum(t.cast("long")).alias("pos"))
    return s.select(_ratio(F.col("tp"), F.col("pp")).alias("precision"), _ratio(F.col("tp"), F.col("pos")).alias("recall"),
                    _ratio(2.0 * F.col("tp"), F.col("pp") + F.col("pos")).alias("f1"))


def class_report(df: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """(label, precision, recall, f1, support), one row per class seen in labels or predictions."""
    cells = confusion(df, y, y_hat)
    sides = F.array(F.struct(F.col("y").cast("string").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
                    F.struct(F.col("y_hat").cast("string").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")))
    hit = F.when(F.col("y") == F.col("y_hat"), F.col("n")).otherwise(0)
    per = (cells.select(hit.alias("hit"), F.explode(sides).alias("s")).groupBy(F.col("s.label").alias("label"))
           .agg((F.sum("hit") / 2).alias("tp"), F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted")))
    return per.select("label", _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
                      _ratio(F.col("tp"), F.col("support")).alias("recall"),
                      _ratio(2.0 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), "support")


def averages(report: DataFrame) -> DataFrame:
    """Macro and weighted averages of a class report."""
    w = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    return report.agg(*[F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")],
                      *[w(c).alias(f"{c}_weighted") for c in ("precision", "recall", "f1")])


def full_report(df: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """Class report followed by accuracy, macro and weighted rows."""
    rep = class_report(df, y, y_hat)
    total = F.sum("support").alias("support")
    macro = rep.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], total).select(F.lit("macro avg").alias("label"), "*")
    w = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    weighted = rep.agg(w("precision"), w("recall"), w("f1"), total).select(F.lit("weighted avg").alias("label"), "*")
    return rep.unionByName(macro).unionByName(weighted)


def matthews(df: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """Matthews correlation for any number of classes."""
    rep = (confusion(df, y, y_hat))
    n = F.sum("n")
    correct = F.sum(F.when(F.col("y") == F.col("y_hat"), F.col("n")).otherwise(0))
    tot = rep.agg(n.alias("s"), correct.alias("c"))
    t = rep.groupBy(F.col("y").cast("string").alias("k")).agg(n.alias("t"))
    p = rep.groupBy(F.col("y_hat").cast("string").alias("k")).agg(n.alias("p"))
    both = t.join(p, "k", "full_outer").fillna(0).agg(
        F.sum(F.col("t").cast("double") * F.col("p")).alias("tp"), F.sum(F.col("t").cast("double") ** 2).alias("tt"),
        F.sum(F.col("p").cast("double") ** 2).alias("pp"))
    b = both.first()
    s = F.col("s").cast("double")
    den = F.sqrt((s * s - F.lit(b["pp"])) * (s * s - F.lit(b["tt"])))
    return tot.select(_ratio(F.col("c") * s - F.lit(b["tp"]), den).alias("mcc"))


def _scores(df: DataFrame, y: str, p: str, positive, bins: int | None) -> DataFrame:
    score = num(p) if bins is None else F.floor(num(p) * bins) / F.lit(float(bins))
    pos = (F.col(y) == F.lit(positive)).cast("long")
    return (df.select(score.alias("score"), pos.alias("pos")).dropna().groupBy("score")
            .agg(F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg")))


def roc_auc(df: DataFrame, y: str = "y", p: str = "p", positive=1, bins: int | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half: positives times negatives scored lower."""
    run = running_totals(_scores(df, y, p, positive, bins), [], ["score"], {"cn": F.col("neg")})
    d = lambda c: F.col(c).cast("double")
    return run.agg(F.try_divide(F.sum(d("pos") * (d("cn") - d("neg") / 2)), F.sum(d("pos")) * F.sum(d("neg"))).alias("roc_auc"))


def roc_curve(df: DataFrame, y: str = "y", p: str = "p", positive=1, bins: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, highest first; ``bins`` coarsens the scores."""
    scores = _scores(df, y, p, positive, bins)
    run = running_totals(scores, [], ["-score"], {"tp": F.col("pos"), "fp": F.col("neg")})
    tot = scores.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    return run.select(F.col("score").alias("threshold"), F.try_divide(F.col("fp"), F.lit(tot["N"])).alias("fpr"),
                      F.try_divide(F.col("tp"), F.lit(tot["P"])).alias("tpr")).orderBy(F.desc("threshold"))


def log_loss(df: DataFrame, y: str = "y", p: str = "p", positive=1) -> DataFrame:
    """Probabilities are clipped to [eps, 1 - eps]."""
    q = F.least(F.greatest(num(p), F.lit(EPS)), F.lit(1 - EPS))
    return df.agg((-F.avg(F.log(F.when(F.col(y) == F.lit(positive), q).otherwise(1 - q)))).alias("log_loss"))


def regression_scores(df: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """(r2, mae, mse, rmse, mape, smape) in one aggregate; |y| is floored at machine epsilon for MAPE,
    a row with y = y_hat = 0 adds 0 to sMAPE."""
    a, b = num(y), num(y_hat)
    e = a - b
    s = df.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(F.when(b.isNotNull(), a)).alias("var"),
               F.avg(F.abs(e) / F.greatest(F.abs(a), F.lit(EPS))).alias("mape"),
               F.avg(F.coalesce(F.try_divide(2 * F.abs(e), F.abs(a) + F.abs(b)), F.when(e.isNotNull(), F.lit(0.0)))).alias("smape"))
    return s.select((1 - F.try_divide(F.col("mse"), F.col("var"))).alias("r2"), "mae", "mse",
                    F.sqrt("mse").alias("rmse"), "mape", "smape")


def forecast_scores(df: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    return regression_scores(df, y, y_hat).select("smape", "mape", "rmse", "mae")


def residuals(df: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    return df.withColumn("residual", num(y) - num(y_hat))


def residual_histogram(df: DataFrame, y: str = "y", y_hat: str = "y_hat", bins: int = 30) -> DataFrame:
    return histogram(residuals(df, y, y_hat), "residual", bins)


def compare_models(results: dict[str, DataFrame]) -> DataFrame:
    """One row per model from one-row metric tables with equal columns."""
    out = None
    for name, m in results.items():
        row = m.select(F.lit(name).alias("model"), *m.columns)
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out


def long_metrics(wide: DataFrame, key: str = "model") -> DataFrame:
    """(model, metric, value)"""
    return wide.unpivot([key], [c for c in wide.columns if c != key], "metric", "value")


def clustering_scores(df: DataFrame, features: list[str], cluster: str) -> DataFrame:
    """(calinski_harabasz, davies_bouldin) from per-cluster moments.

    One aggregate gives the centroids (clusters × features numbers, checked), a second the mean distances.
    """
    n = F.count(F.lit(1)).alias("n")
    agg = df.groupBy(cluster).agg(n, *[F.avg(num(c)).alias(f"m{i}") for i, c in enumerate(features)]).limit(10_001).collect()
    if len(agg) > 10_000:
        raise ValueError("more than 10000 clusters")
    cents = {r[cluster]: [r[f"m{i}"] for i in range(len(features))] for r in agg}
    size = {r[cluster]: r["n"] for r in agg}
    table = df.sparkSession.createDataFrame([(k, v) for k, v in cents.items()],
                                            f"{cluster} {dict(df.dtypes)[cluster]}, _c array<double>")
    sq = sum([(num(c) - F.col("_c")[i]) ** 2 for i, c in enumerate(features)], F.lit(0.0))
    per = (df.join(F.broadcast(table), cluster).groupBy(cluster)
           .agg(F.sum(sq).alias("w"), F.avg(F.sqrt(sq)).alias("s")).collect())
    total, k = sum(size.values()), len(cents)
    mean = [sum(size[c] * v[i] for c, v in cents.items()) / total for i in range(len(features))]
    between = sum(size[c] * math.dist(v, mean) ** 2 for c, v in cents.items())
    within = sum(r["w"] for r in per)
    ch = (between / (k - 1)) / (within / (total - k)) if k > 1 and within else None
    s = {r[cluster]: r["s"] for r in per}
    db = sum(max((s[a] + s[b]) / d for b in cents if b != a and (d := math.dist(cents[a], cents[b])) > 0)
             for a in cents) / k if k > 1 else None
    return df.sparkSession.createDataFrame([(ch, db)], "calinski_harabasz double, davies_bouldin double")


def score_predictions(predictions: DataFrame, truth: DataFrame, key: str, y: str = "y", y_hat: str = "y_hat",
                      task: str = "classification") -> DataFrame:
    """Join exported predictions to the truth on an id; ``correct`` for classes, ``residual`` for numbers."""
    joined = predictions.join(truth.select(key, F.col(y).alias("y")), key)
    if task == "classification":
        return joined.withColumn("correct", (F.col("y").cast("string") == F.col(y_hat).cast("string")).cast("int"))
    return residuals(joined, "y", y_hat)
