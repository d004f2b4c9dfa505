"""Feature selection."""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from millrace.operators import models
from millrace.operators.binning import bin_code, frequency_edges_of
from millrace.operators.correlate import pearson
from millrace.plans.counting import num
from millrace.plans.lineage import cut


def variances(df: DataFrame, cols: list[str], threshold: float = 0.0) -> DataFrame:
    """(feature, variance, kept): population variance must exceed the threshold."""
    row = df.agg(*[F.var_pop(num(c)).alias(f"v{i}") for i, c in enumerate(cols)])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(cols)])
    return row.select(F.explode(cells).alias("x")).select("x.*").withColumn("kept", F.coalesce(F.col("variance") > threshold, F.lit(False)))


def drop_low_variance(df: DataFrame, cols: list[str], threshold: float = 0.0) -> DataFrame:
    return df.drop(*[r["feature"] for r in variances(df, cols, threshold).filter("not kept").collect()])


def f_scores(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """(feature, f): one-way ANOVA F between the classes, from counts, sums and squares per class."""
    data = df.filter(F.col(target).isNotNull())
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), num(c).alias("x")) for c in cols])
    per = (data.select(F.col(target).alias("c"), F.explode(cells).alias("k")).select("c", "k.*").filter("x is not null")
           .groupBy("feature", "c").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")))
    n, k = F.sum("n"), F.count(F.lit(1))
    total = F.sum(F.col("n") * F.col("m"))
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - total * total / n
    within = F.sum(F.col("n") * F.col("v"))
    return per.groupBy("feature").agg(F.try_divide(between / (k - 1), within / (n - k)).alias("f"))


def mutual_information(df: DataFrame, cols: list[str], target: str, bins: int = 10) -> DataFrame:
    """(feature, mi) in nats between equal-frequency bins of a feature and the classes."""
    coded = df.filter(F.col(target).isNotNull())
    edges = frequency_edges_of(df, cols, bins)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), bin_code(c, edges[c]).alias("b")) for c in cols if c in edges])
    joint = (coded.select(F.col(target).alias("c"), F.explode(cells).alias("k")).select("c", "k.*").filter("b is not null")
             .groupBy("feature", "b", "c").agg(F.count(F.lit(1)).alias("n")))
    by_b = joint.groupBy("feature", "b").agg(F.sum("n").alias("nb"))
    by_c = joint.groupBy("feature", "c").agg(F.sum("n").alias("nc"))
    tot = joint.groupBy("feature").agg(F.sum("n").alias("t"))
    full = joint.join(by_b, ["feature", "b"]).join(by_c, ["feature", "c"]).join(tot, "feature")
    d = lambda c: F.col(c).cast("double")
    return full.groupBy("feature").agg(F.sum(d("n") / d("t") * F.log(d("n") * d("t") / (d("nb") * d("nc")))).alias("mi"))


def k_best(scores: DataFrame, column: str, k: int) -> list[str]:
    return [r["feature"] for r in scores.orderBy(F.desc_nulls_last(column), "feature").limit(k).collect()]


def correlated(df: DataFrame, cols: list[str], limit: float = 0.95) -> list[str]:
    """Columns to drop: the later of each pair with |r| above the limit, scanning left to right."""
    high = {(r["a"], r["b"]) for r in pearson(df, cols).collect() if r["r"] is not None and abs(r["r"]) > limit}
    gone: list[str] = []
    for i, a in enumerate(cols):
        if a not in gone:
            gone += [b for b in cols[i + 1:] if b not in gone and (a, b) in high]
    return gone


def eliminate(df: DataFrame, cols: list[str], target: str, keep: int = 10, task: str = "classification", trees: int = 20,
              depth: int = 5) -> DataFrame:
    """(feature, rank): recursive elimination, one feature per random forest; survivors rank 1."""
    left, rows = list(cols), []
    df = cut(df.select(*dict.fromkeys([*cols, target])))  # read again for each forest
    while len(left) > keep:
        f = models.fit(df, "random_forest", left, target, task, {"n_estimators": trees, "max_depth": depth})
        worst = min(zip(f.model.stages[-1].featureImportances.toArray(), left))[1]
        left.remove(worst)
        rows.append((worst, len(left) - keep + 2))
    return df.sparkSession.createDataFrame([(c, 1) for c in left] + rows[::-1], "feature string, rank int")


def principal_components(df: DataFrame, cols: list[str], k: int = 10) -> tuple[DataFrame, list[float]]:
    """``pc_0`` ... of the centred columns and the explained shares. The sign of a component is arbitrary. Null cells are an error."""
    mean = df.agg(*[F.avg(num(c)).alias(c) for c in cols]).first()
    centred = df.withColumns({f"_c_{c}": num(c) - F.lit(mean[c]) for c in cols})
    data = VectorAssembler(inputCols=[f"_c_{c}" for c in cols], outputCol="_f", handleInvalid="error").transform(centred)
    model = PCA(k=k, inputCol="_f", outputCol="_p").fit(data)
    arr = vector_to_array("_p")
    out = model.transform(data).withColumns({f"pc_{i}": arr[i] for i in range(k)})
    return out.drop("_f", "_p", *[f"_c_{c}" for c in cols]), list(model.explainedVariance.toArray())
