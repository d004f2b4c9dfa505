from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import metrics, models as M, select as S, tune as T
from millrace.operators.split import folds, random_split
from millrace.plans.lineage import cut, scratch_path
from millrace.sources import sinks as K
from workload.registry import query, table


def _r(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _orders(spark, sf):
    """Two classes that a model can learn: dear orders by their size and discount."""
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("items"), F.sum("l_quantity").alias("quantity"),
        F.avg("l_discount").alias("discount"), F.sum("l_extendedprice").alias("price"))
    return items.withColumn("y", F.when(F.col("price") > 150000, "big").otherwise("small"))


FEATURES = ["items", "quantity", "discount"]


def _scored(spark, sf, name, params, task="classification", target="y", features=FEATURES):
    df = cut(random_split(cut(_orders(spark, sf)), ["l_orderkey"]))
    f = M.fit(df.filter("split = 'train'"), name, features, target, task, params)
    return f, M.predict(f, df.filter("split = 'test'"), ["l_orderkey", target])


_ITEMS = """d AS (SELECT l_orderkey, count(*)::DOUBLE items, sum(l_quantity) quantity, avg(l_discount) discount, sum(l_extendedprice) price FROM lineitem GROUP BY 1),
 o AS (SELECT *, CASE WHEN price > 150000 THEN 'big' ELSE 'small' END AS y FROM d)"""


def _classifier(name, params):
    """The model against the share of the larger class: it must be right at least two points more often on rows it has not seen."""
    def run(spark, sf):
        f, out = _scored(spark, sf, name, params)
        larger = _orders(spark, sf).groupBy("y").count().agg(F.max("count") / F.sum("count")).first()[0]
        return metrics.accuracy(out, "y", "prediction").select(
            F.lit(name).alias("model"), F.round(F.lit(larger), 8).alias("majority"), (F.col("accuracy") >= larger + 0.02).alias("learnt"))
    return run


_MAJORITY = "WITH " + _ITEMS + " SELECT '{}' AS model, round(max(n) * 1.0::DOUBLE / sum(n), 8) AS majority, true AS learnt FROM (SELECT count(*) AS n FROM o GROUP BY y)"
for _name, _params in (("logistic_regression", {"max_iter": 50}), ("random_forest", {"n_estimators": 20, "max_depth": 5}),
                       ("gradient_boosting", {"n_estimators": 10}), ("xgboost", {"n_estimators": 5, "max_depth": 4}),
                       ("svm_rbf", {"components": 32}), ("naive_bayes", {}), ("adaboost", {"n_estimators": 6}),
                       ("mlp", {"hidden": [8], "max_iter": 60})):
    query(f"fit_{_name}", _MAJORITY.format(_name))(_classifier(_name, _params))


def _regressor(name, params):
    """The model against the best line through one feature: its r2 on rows it has not seen may be a tenth less at most."""
    def run(spark, sf):
        f, out = _scored(spark, sf, name, params, "regression", "price")
        line = _orders(spark, sf).agg(F.pow(F.corr("price", "quantity"), F.lit(2))).first()[0]
        return metrics.regression_scores(out, "price", "prediction").select(
            F.lit(name).alias("model"), F.round(F.lit(line), 6).alias("line_r2"), (F.col("r2") >= line - 0.1).alias("learnt"))
    return run


_LINE = "WITH " + _ITEMS + " SELECT '{}' AS model, round(regr_r2(price, quantity), 6) AS line_r2, true AS learnt FROM o"
for _name, _params in (("linear_regression", {}), ("ridge", {}), ("lasso", {}), ("elastic_net", {"alpha": 0.1}),
                       ("lightgbm", {"n_estimators": 10})):
    query(f"fit_{_name}", _LINE.format(_name))(_regressor(_name, _params))


@query("fit_linear_coefficients", """
WITH d AS (SELECT l_orderkey, sum(l_quantity) q, sum(l_extendedprice) p FROM lineitem GROUP BY 1)
SELECT round(regr_slope(p, q), 2) AS slope, round(regr_intercept(p, q), 0) AS intercept FROM d""")
def fit_linear_coefficients(spark, sf):
    f = M.fit(_orders(spark, sf), "linear_regression", ["quantity"], "price", "regression")
    m = f.model.stages[-1]
    return _r(_r(spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double"), 2, "slope"), 0, "intercept")


@query("fit_ridge_one_feature", f"WITH {_ITEMS} SELECT round(covar_pop(price, quantity) * count(*) / (var_pop(quantity) * count(*) + 100000), 4) AS slope FROM o")
def fit_ridge_one_feature(spark, sf):
    f = M.fit(_orders(spark, sf), "ridge", ["quantity"], "price", "regression", {"alpha": 100000.0})
    return _r(spark.createDataFrame([(float(f.model.stages[-1].coefficients[0]),)], "slope double"), 4, "slope")


@query("fit_naive_bayes_posterior", f"""
WITH {_ITEMS}, m AS (SELECT y, count(*)::DOUBLE n, avg(items) a, var_pop(items) va, avg(quantity) b, var_pop(quantity) vb FROM o GROUP BY 1),
 e AS (SELECT 1e-9 * greatest(var_pop(items), var_pop(quantity)) e FROM o),
 s AS (SELECT l_orderkey, m.y, ln(n / (SELECT count(*) FROM o)) - 0.5 * (ln(2 * pi() * (va + e)) + ln(2 * pi() * (vb + e)) + pow(items - a, 2) / (va + e) + pow(quantity - b, 2) / (vb + e)) AS l FROM o, m, e)
SELECT x.l_orderkey, round(1 / (1 + exp(z.l - x.l)), 5) AS proba_big FROM s x JOIN s z ON x.l_orderkey = z.l_orderkey AND x.y = 'big' AND z.y = 'small'""")
def fit_naive_bayes_posterior(spark, sf):
    df = _orders(spark, sf)
    f = M.fit(df, "naive_bayes", ["items", "quantity"], "y")
    return _r(M.predict(f, df, ["l_orderkey"]).select("l_orderkey", "proba_big"), 5, "proba_big")


@query("fit_multiclass_report")
def fit_multiclass_report(spark, sf):
    """Boosted trees one class against the rest."""
    df = table(spark, sf, "part").withColumn("y", F.when(F.col("p_size") < 15, "s").when(F.col("p_size") < 35, "m").otherwise("l"))
    df = df.select("p_partkey", F.col("p_size").cast("double").alias("size"), "p_retailprice", "y")
    f = M.fit(df, "catboost", ["size", "p_retailprice"], "y", params={"n_estimators": 5, "max_depth": 3})
    return metrics.full_report(M.predict(f, df, ["p_partkey", "y"]), "y", "prediction")


@query("predict_threshold_labels")
def predict_threshold_labels(spark, sf):
    f, out = _scored(spark, sf, "logistic_regression", {"max_iter": 30})
    return out


@query("predict_preview")
def predict_preview(spark, sf):
    df = _orders(spark, sf)
    f = M.fit(df, "naive_bayes", FEATURES, "y")
    return M.preview_predictions(f, df, ["l_orderkey"], 50)


@query("models_saved_and_loaded", "SELECT 'nb' AS model, count(DISTINCT l_orderkey) AS rows FROM lineitem")
def models_saved_and_loaded(spark, sf):
    df = _orders(spark, sf)
    f = M.fit(df, "naive_bayes", FEATURES, "y")
    folder = scratch_path(spark, "models")
    K.save_models(spark, {"nb": f.model}, folder)
    back = K.load_models(spark, folder)["nb"]
    return back.transform(df).agg(F.count("prediction").alias("rows")).select(F.lit("nb").alias("model"), "rows")


@query("cluster_kmeans")
def cluster_kmeans(spark, sf):
    _, out = M.cluster(_orders(spark, sf), "kmeans", FEATURES, 4)
    s = M.silhouette(out)
    return metrics.clustering_scores(out, FEATURES, "cluster").withColumn("silhouette", F.lit(s))


@query("cluster_hierarchical")
def cluster_hierarchical(spark, sf):
    _, out = M.cluster(_orders(spark, sf), "hierarchical", FEATURES, 4)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("feature_importance")
def feature_importance(spark, sf):
    f = M.fit(_orders(spark, sf), "random_forest", FEATURES, "y", params={"n_estimators": 10, "max_depth": 4})
    return M.importance(f, 20)


@query("permutation_importance")
def permutation_importance(spark, sf):
    df = _orders(spark, sf)
    return M.permutation_importance(M.fit(df, "naive_bayes", FEATURES, "y"), df, "y", ["l_orderkey"])


@query("shapley_values")
def shapley_values(spark, sf):
    df = _orders(spark, sf)
    f = M.fit(df, "linear_regression", FEATURES, "price", "regression")
    return M.shapley(f, df, df, "l_orderkey", permutations=3)


@query("learning_curve")
def learning_curve(spark, sf):
    return T.learning_curve(_orders(spark, sf), "naive_bayes", FEATURES, "y", ["l_orderkey"], points=3)


@query("tune_random_search")
def tune_random_search(spark, sf):
    _, rows, _ = T.search(_orders(spark, sf), "logistic_regression", FEATURES, "y", ["l_orderkey"], n_iter=2, k=2, space={"C": ("uniform", 0.01, 10), "max_iter": [20]})
    return rows


@query("tune_grid_search")
def tune_grid_search(spark, sf):
    _, _, gain = T.search(_orders(spark, sf), "ridge", FEATURES, "price", ["l_orderkey"], task="regression", scoring="r2", method="grid", k=2, space={"alpha": [0.1, 10.0]})
    return gain


@query("tune_compare_models")
def tune_compare_models(spark, sf):
    return T.compare(_orders(spark, sf), {"naive_bayes": {}, "logistic_regression": {"max_iter": 20}}, FEATURES, "y", ["l_orderkey"], k=2)


@query("select_variance", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(var_pop({c}), 4) AS variance, var_pop({c}) > 1 AS kept FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")))
def select_variance(spark, sf):
    return _r(S.variances(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"], 1.0), 4, "variance")


@query("select_f_test", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS feature, round((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))), 6) AS f
FROM (SELECT l_returnflag, count(*)::DOUBLE n, avg({c}) m, var_pop({c}) v FROM lineitem GROUP BY 1)""" for c in ("l_quantity", "l_discount", "l_extendedprice")))
def select_f_test(spark, sf):
    return _r(S.f_scores(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"], "l_returnflag"), 6, "f")


@query("select_mutual_information", """
WITH e AS (SELECT """ + ", ".join(f"quantile_cont(p_retailprice, {i / 10}) e{i}" for i in range(1, 10)) + """ FROM part),
 d AS (SELECT p_type c, """ + " + ".join(f"(p_retailprice > e{i})::INT" for i in range(1, 10)) + """ AS b FROM part, e),
 j AS (SELECT b, c, count(*)::DOUBLE n FROM d GROUP BY 1, 2), t AS (SELECT sum(n) t FROM j)
SELECT 'p_retailprice' AS feature, round(sum(n / t * ln(n * t / (nb * nc))), 7) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY b) nb, sum(n) OVER (PARTITION BY c) nc FROM j), t""")
def select_mutual_information(spark, sf):
    return _r(S.mutual_information(table(spark, sf, "part"), ["p_retailprice"], "p_type"), 7, "mi")


@query("select_best_columns", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def select_best_columns(spark, sf):
    """Columns of variance above one, and of these the two whose squared correlation with the price is largest, taken from the table."""
    items, numbers = table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    varied = S.drop_low_variance(items, numbers, 1.0)
    left = [c for c in numbers if c in varied.columns]
    scores = varied.agg(*[F.pow(F.corr(c, "l_extendedprice"), F.lit(2)).alias(c) for c in left]).unpivot([], left, "feature", "r2")
    return varied.select("l_orderkey", "l_linenumber", *sorted(S.k_best(scores, "r2", 2), reverse=True))


@query("select_correlated", """
SELECT 'net' AS dropped WHERE (SELECT corr(l_extendedprice, l_extendedprice * (1 - l_discount)) FROM lineitem) > 0.95
UNION ALL SELECT 'l_tax' WHERE (SELECT corr(l_extendedprice, l_tax) FROM lineitem) > 0.95""")
def select_correlated(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("net", F.expr("l_extendedprice * (1 - l_discount)"))
    gone = S.correlated(df, ["l_extendedprice", "net", "l_discount", "l_tax"])
    return spark.createDataFrame([(c,) for c in gone], "dropped string")


@query("select_elimination")
def select_elimination(spark, sf):
    return S.eliminate(_orders(spark, sf), FEATURES, "y", keep=1, trees=5, depth=3)


@query("select_pca", """
WITH d AS (SELECT l_quantity * 10 a, l_linenumber * 1.0::DOUBLE b FROM lineitem), s AS (SELECT var_samp(a) va, var_samp(b) vb, covar_samp(a, b) c FROM d)
SELECT round((va + vb) / 2 + sqrt(pow((va - vb) / 2, 2) + c * c), 4) AS variance FROM s""")
def select_pca(spark, sf):
    df = table(spark, sf, "lineitem").select((F.col("l_quantity") * 10).alias("a"), F.col("l_linenumber").alias("b"))
    out, _ = S.principal_components(df, ["a", "b"], 2)
    return out.agg(F.round(F.var_samp("pc_0"), 4).alias("variance"))
