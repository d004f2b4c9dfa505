"""Null, tie and edge rules on literal rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, numeric, predicates as P, terms, text
from millrace.operators import (binning, charts, clean, columns, encode, metrics, models, neighbours, profile, scale, split,
                                text_features, tune)
from millrace.plans.lineage import checkpoint_dir


def col(df, *exprs):
    rows = df.select(*exprs).collect()
    return [r[0] for r in rows] if len(exprs) == 1 else [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, None, float("nan")), (4, "a", -3.0), (5, "c", 10.0)],
                                 "id long, g string, x double").coalesce(1)


def test_checkpoint_folder_is_the_configured_one(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_predicate_null_rules(gaps):
    assert col(gaps, P.predicate("x", "!=", "1")) == [False, True, True, True, True]
    assert col(gaps, P.predicate("x", ">", "0"))[1] is False
    assert col(gaps, P.predicate("g", "not isin", "a,b")) == [False, False, True, False, True]
    assert col(gaps, P.predicate("g", "contains", "^a|c$")) == [True, False, False, True, True]
    assert [P.typed(x) for x in ("3", "3.5", "x")] == [3, 3.5, "x"]


def test_modulo_takes_the_divisor_sign(spark):
    df = spark.createDataFrame([(-3.0, 2.0), (3.0, -2.0), (5.0, 0.0)], "a double, b double").coalesce(1)
    assert col(df, numeric.binary("a", "Modulo", "b")) == [1.0, -1.0, None]
    assert col(df, numeric.binary("a", "/", 0)) == [None] * 3


def test_text_rules(spark):
    df = spark.createDataFrame([("Été à la-mer 12",), (None,), ("a.b.c",)], "t string").coalesce(1)
    assert col(df, text.clean("t", digits=True)) == ["été à lamer ", None, "abc"]
    assert col(df, text.split_keep("t", ".", 2)) == [None, None, "c"]
    assert col(df, text.extract("t", "[0-9]+")) == ["12", None, None]
    assert col(df, text.words("t"))[0] == ["été", "à", "la", "mer", "12"]


def test_dates(spark):
    df = spark.createDataFrame([("2024-03-02 23:59:10",), ("nope",)], "d string").coalesce(1)
    got = dates.add_parts(df, "d").collect()
    assert (got[0]["d_Year"], got[0]["d_DayOfWeek"], got[0]["d_IsWeekend"], got[1]["d_Year"], got[1]["d_IsWeekend"]) == (2024, 5, 1, None, 0)
    assert col(df, dates.epoch_seconds(dates.as_time(df, "d")))[0] == 1709423950


def test_short_names(spark):
    df = spark.createDataFrame([("http://x#Y", "iri"), ("http://x/z", "iri"), ("_:abcdefghijkl", "blank"), ("w" * 50, "literal")], "t string, k string").coalesce(1)
    assert col(df, terms.short_name(F.col("t"), F.col("k"))) == ["Y", "z", "_:abcdefgh", "w" * 40 + "…"]


def test_kinds(spark):
    rows = [(bool(i % 2), "a" if i % 2 else "b", float(i % 7), i, f"a rather long text number {i}", "abc"[i % 3]) for i in range(200)]
    df = spark.createDataFrame(rows, "flag boolean, two string, num double, key long, long_text string, cat string")
    assert profile.kinds_dict(df) == {"flag": "binary", "two": "binary", "num": "numeric", "key": "id_like", "long_text": "text", "cat": "categorical"}
    assert profile.kinds_dict(columns.set_kind(df, "num", "categorical"))["num"] == "categorical"


def test_empty_and_constant(spark):
    empty = spark.createDataFrame([], "id long, x double, g string")
    assert profile.describe_numeric(empty, ["x"]).first()["count"] == 0
    assert charts.histogram(empty, "x").count() == 0
    const = spark.createDataFrame([(i, 5.0) for i in range(4)], "id long, x double")
    assert set(col(const, scale.standard_expr("x", scale.fit_moments(const, ["x"])))) == {0.0}
    assert set(col(const, scale.min_max_expr("x", scale.fit_min_max(const, ["x"])))) == {0.0}
    assert charts.histogram(const, "x").first()["n"] == 4


def test_cleaning_order_matters(spark):
    df = spark.createDataFrame([(1, None, 10.0), (2, 1.0, None), (3, 2.0, 30.0)], "id long, a double, b double")
    got = clean.clean(df, {"a": "drop_rows", "b": "mean"}).orderBy("id").collect()
    assert [(r["id"], r["b"]) for r in got] == [(2, 30.0), (3, 30.0)]
    got = clean.clean(df, {"b": "mean", "a": "drop_rows"}).orderBy("id").collect()
    assert [(r["id"], r["b"]) for r in got] == [(2, 20.0), (3, 30.0)]


def test_zscore_drops_null_rows(gaps):
    assert clean.drop_zscore(gaps, clean.fit_zscore(gaps, ["x"])).count() == 3


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (2, None, 3), (2, None, 4), (3, "y", 5)], "a int, b string, ord int")
    assert sorted(r["ord"] for r in clean.drop_duplicates(df, ["ord"]).collect()) == [1, 3, 5]
    assert sorted(r["ord"] for r in clean.drop_duplicates(df, ["ord"], keep="last").collect()) == [2, 4, 5]
    assert sorted(r["ord"] for r in clean.drop_duplicates(df, ["ord"], keep="none").collect()) == [5]
    assert {r["ord"]: r["is_duplicate"] for r in clean.flag_duplicates(df, ["ord"], ["a", "b"]).collect()} == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0}


def test_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in range(0, 11)] + [(None,)], "x double").coalesce(1)
    assert binning.width_edges(df, "x", 5) == [0, 2, 4, 6, 8, 10]
    assert col(df, binning.bin_code("x", [0, 2, 4, 6, 8, 10])) == [0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, None]
    assert col(df, binning.bin_code("x", [0, 5, 9], include_lowest=False))[0] is None


def test_encoders_on_unseen_and_null(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 7.0)], "c string, y double")
    test = spark.createDataFrame([("a",), ("z",), (None,)], "c string").coalesce(1)
    lk = encode.fit_labels(train, "c")
    assert [r["k"] for r in encode.apply_labels(test, "c", lk, "k", unknown=-1).collect()] == [0, -1, -1]
    t = encode.apply_target(test, "c", encode.fit_target(train, "c", "y", method="m"), "t").collect()
    assert [r["t"] for r in t] == [pytest.approx((4 + 4) / 3), 4.0, 4.0]
    assert [r["t"] for r in encode.leave_one_out(train, "c", "y", "t", apply_to=test).collect()] == [2.0, 4.0, 4.0]
    with pytest.raises(ValueError):
        encode.fit_categories(train, "c", limit=1)


def test_encoder_large_path(spark, monkeypatch):
    from millrace.plans import lookup
    df = spark.createDataFrame([("hot",)] * 60 + [(f"k{i}",) for i in range(60)], "c string")
    want = sorted(map(tuple, encode.apply_counts(df, "c", encode.fit_counts(df, "c"), "n").collect()))
    big = lookup.fit_lookup(df.groupBy("c").agg(F.count(F.lit(1)).alias("n")), ["c"], limit=2)
    assert sorted(map(tuple, encode.apply_counts(df, "c", big, "n").collect())) == want


def test_power_lambda_is_the_maximum(spark):
    rng = np.random.default_rng(0)
    x = np.exp(rng.normal(1, 0.5, 400))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")

    def loglik(lam):
        t = np.log(x) if abs(lam) < 1e-12 else (x ** lam - 1) / lam
        return -len(x) / 2 * np.log(t.var()) + (lam - 1) * np.log(x).sum()

    lam = scale.fit_power(df, ["x"], "box-cox")["x"][0]
    grid = np.linspace(-2, 2, 4001)
    assert lam == pytest.approx(grid[np.argmax([loglik(g) for g in grid])], abs=5e-3)
    out = df.select(scale.power_expr("x", scale.fit_power(df, ["x"])).alias("z")).agg(F.avg("z"), F.stddev_pop("z")).first()
    assert out[0] == pytest.approx(0, abs=1e-9) and out[1] == pytest.approx(1)


def test_quantile_transform(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 2, 10]] + [(None,)], "x double").coalesce(1)
    u = col(df, scale.quantile_expr("x", scale.fit_quantile(df.dropna(), ["x"])))
    assert u[0] == 0.0 and u[1] == u[2] == u[3] == pytest.approx(0.5) and u[4] == 1.0 and u[5] is None


def test_splits(spark):
    df = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(200)], "id long, y string")
    s = split.stratified_split(df, ["id"], "y", 0.2, 0.2)
    n = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert n[("a", "test")] == 36 and n[("b", "test")] == 4 and n[("a", "val")] == 36 and s.count() == 200
    over = split.oversample(df, ["id"], "y")
    assert {r["y"]: r["count"] for r in over.groupBy("y").count().collect()} == {"a": 180, "b": 180}
    assert {r["y"]: r["count"] for r in split.undersample(df, ["id"], "y").groupBy("y").count().collect()} == {"a": 20, "b": 20}
    f = split.folds(df, ["id"], 4, "y").groupBy("fold", "y").count().collect()
    assert {(r["fold"], r["y"]): r["count"] for r in f} == {(i, y): n for i in range(4) for y, n in (("a", 45), ("b", 5))}


def test_smote_and_adasyn(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b), 0) for i, (a, b) in enumerate(rng.normal(0, 1, (60, 2)))]
    rows += [(100 + i, float(a), float(b), 1) for i, (a, b) in enumerate(rng.normal(2, 1, (13, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    out = neighbours.smote(df, ["a", "b"], "y", "id")
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 60, 1: 60}
    lo = min(r[1] for r in rows[60:])
    assert out.filter("synthetic = 1").agg(F.min("a")).first()[0] >= lo
    made = neighbours.adasyn(df, ["a", "b"], "y", "id", 1).count()
    assert abs(made - 47) <= 13


def test_metrics_with_ties_and_empty_class(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (0, 1, 0.5), (1, 0, 0.9), (0, 0, 0.1)], "y int, y_hat int, p double")
    assert metrics.roc_auc(df).first()[0] == pytest.approx(0.875)
    assert metrics.roc_auc(df.filter("y = 1")).first()[0] is None
    assert metrics.binary_scores(df, positive=7).first()["f1"] == 0.0
    perfect = df.withColumn("y_hat", F.col("y"))
    assert metrics.matthews(perfect).first()[0] == pytest.approx(1.0)
    assert metrics.matthews(df.withColumn("y_hat", 1 - F.col("y"))).first()[0] == pytest.approx(-1.0)


def test_roc_auc_range_path(spark, monkeypatch):
    from millrace.plans import ordering
    df = spark.createDataFrame([(i % 3 == 0, (i * 37 % 101) / 100) for i in range(500)], "y boolean, p double").withColumn("y", F.col("y").cast("int"))
    want = metrics.roc_auc(df).first()[0]
    monkeypatch.setattr(metrics, "running_totals", lambda d, by, order, add: ordering.prefix_totals(d, by, order, add))
    assert metrics.roc_auc(df).first()[0] == pytest.approx(want)


def test_tfidf_rows_have_unit_length(spark):
    df = spark.createDataFrame([(1, "the cat the dog"), (2, "the bird"), (3, ""), (4, None)], "id long, t string")
    got = text_features.tfidf(df, "id", "t", 3)
    assert {round(r["s"], 9) for r in got.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()} == {1.0}
    assert text_features.fit_vocabulary(df, "id", "t", 2) == {"the": 2, "bird": 1}


def test_predictions_threshold_and_labels(spark):
    df = spark.createDataFrame([(i, float(i), "yes" if i > 50 else "no") for i in range(100)], "id long, x double, y string")
    f = models.fit(df, "logistic_regression", ["x"], "y")
    out = models.predict(f, df.drop("y"), ["id"], threshold=0.9)
    assert set(out.columns) == {"id", "prediction", "proba_no", "proba_yes"}
    assert out.filter("prediction = 'yes' and proba_yes < 0.9").count() == 0
    assert {r[0] for r in models.predict(f, df, ["id"], raw=True).select("prediction").distinct().collect()} == {0, 1}
    aligned = models.predict(f, df.select("id"), ["id"], like=df)
    assert aligned.count() == 100


def test_adaboost_and_search(spark):
    df = spark.createDataFrame([(i, float(i % 10), float(i % 7), "abc"[(i % 10) // 4]) for i in range(150)], "id long, a double, b double, y string")
    f = models.fit(df, "adaboost", ["a", "b"], "y", params={"n_estimators": 8, "learning_rate": 1.0})
    acc = metrics.accuracy(models.predict(f, df, ["y"]), "y", "prediction").first()[0]
    assert acc > 0.85
    assert len(tune.draw_params(tune.SPACES["ridge"], 5)) == 5
    assert tune.draw_params({"a": [1, 2]}, 20, 1) in ([{"a": 1}, {"a": 2}], [{"a": 2}, {"a": 1}])


def test_a_fit_reads_its_input_once(spark):
    from millrace.operators import select
    base = spark.createDataFrame([(i, float(i % 7), float(i % 5), "x" if i % 7 > 3 else "y") for i in range(140)], "id long, a double, b double, y string").repartition(2)
    for run in (lambda d: models.fit(d, "mlp", ["a", "b"], "y", params={"hidden": [3], "max_iter": 5}),
                lambda d: select.eliminate(d, ["a", "b"], "y", keep=1, trees=2, depth=2)):
        seen = spark.sparkContext.accumulator(0)

        @F.udf("double")
        def counted(x):
            seen.add(1)
            return x

        run(base.withColumn("a", counted.asNondeterministic()("a")))
        assert seen.value == 140


def test_shapley_adds_up_for_a_linear_model(spark):
    df = spark.createDataFrame([(i, float(i % 5), float(i % 3), 2.0 * (i % 5) - (i % 3)) for i in range(60)], "id long, a double, b double, y double")
    f = models.fit(df, "linear_regression", ["a", "b"], "y", "regression")
    one = df.filter("id = 4")
    bg = df.filter("id = 0")
    got = {r["feature"]: r["value"] for r in models.shapley(f, one, bg, "id", 4).collect()}
    assert got == {"a": pytest.approx(8.0, abs=1e-4), "b": pytest.approx(-1.0, abs=1e-4)}


def test_shapley_joins_in_parts_of_bounded_size(spark, monkeypatch):
    """The number of parts follows the rows, not the session; values stay."""
    df = spark.createDataFrame([(i, float(i % 7), float(i % 3), 2.0 * (i % 7) - (i % 3)) for i in range(3000)], "id long, a double, b double, y double")
    f = models.fit(df, "linear_regression", ["a", "b"], "y", "regression")
    values = lambda out: {(r["id"], r["feature"]): round(r["value"], 6) for r in out.collect()}
    want = values(models.shapley(f, df, df, "id", 2))
    monkeypatch.setattr(models, "PART_ROWS", 300)
    out = models.shapley(f, df, df, "id", 2)
    assert ", 20), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert values(out) == want and len(want) == 6000


def test_kde_integrates_to_one(spark):
    df = spark.createDataFrame([(float(x),) for x in np.random.default_rng(0).normal(size=500)], "x double")
    d = charts.density(df, "x", grid=(-6.0, 6.0)).collect()
    assert sum(r["density"] for r in d) * 12 / 199 == pytest.approx(1.0, abs=1e-2)
    two = df.withColumn("y", F.col("x") * 0.5 + F.rand(3))
    assert charts.density2d(two, "x", "y").count() == 625
    assert not math.isnan(charts.density2d(two, "x", "y").first()["density"])


@pytest.mark.parametrize("name", ["naive_bayes", "adaboost", "logistic_regression"])
def test_saved_models_predict_labels(spark, tmp_path, name):
    from millrace.sources import sinks
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5), "high" if i % 7 > 3 else "low") for i in range(70)], "id long, a double, b double, y string")
    f = models.fit(df, name, ["a", "b"], "y", params={"n_estimators": 3} if name == "adaboost" else None)
    sinks.save_models(spark, {"one/" + name: f}, str(tmp_path))
    back = sinks.load_models(spark, str(tmp_path))["one/" + name]
    assert (back.labels, back.features, back.task) == (f.labels, f.features, f.task)
    want = {r["id"]: r["prediction"] for r in models.predict(f, df, ["id"]).collect()}
    assert {r["id"]: r["prediction"] for r in models.predict(back, df, ["id"]).collect()} == want and set(want.values()) == {"high", "low"}
    if name != "naive_bayes":
        assert models.importance(back).first()["feature"] == "a"
