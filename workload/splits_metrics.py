from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import metrics as M, profile, split as S
from workload.registry import query, table


def _r(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in (cols or df.columns)})


def _ord(key: str) -> str:
    return f"md5(concat_ws('#', {key}, '42'))"


@query("split_random", f"""
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {_ord('o_orderkey')}) <= ceil(count(*) OVER () * 0.2) THEN 'test' ELSE 'train' END AS split FROM orders""")
def split_random(spark, sf):
    return S.random_split(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


@query("split_threshold", """
SELECT o_orderkey, CASE WHEN ('0x' || substr(md5(concat_ws('#', o_orderkey, '42')), 1, 8))::BIGINT / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS split FROM orders""")
def split_threshold(spark, sf):
    return S.random_split(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], exact=False)


@query("split_stratified", f"""
WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_ord('o_orderkey')}) i,
 ceil(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) k, count(*) OVER (PARTITION BY o_orderstatus) n FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN i <= k THEN 'test' WHEN i <= k + ceil((n - k) * (0.1::DOUBLE / (1 - 0.2::DOUBLE))) THEN 'val' ELSE 'train' END AS split FROM r""")
def split_stratified(spark, sf):
    return S.stratified_split(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], "o_orderstatus", 0.2, 0.1)


@query("split_sequential", """
SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts, event_id) > count(*) OVER () - ceil(count(*) OVER () * 0.2) THEN 'test' ELSE 'train' END AS split FROM events""")
def split_sequential(spark, sf):
    return S.sequential_split(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"]).drop("ts")


@query("target_assembly", """
SELECT doc_id, lang, n_chars, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND doc_id % 3 > 0""")
def target_assembly(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    df = df.withColumn("quality", F.expr("if(doc_id % 3 = 0, null, quality)"))
    return S.assemble(df, "quality", exclude=["text", "source", "toxic"])


@query("balance_under", f"""
SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_ord('doc_id')}) i FROM labels)
WHERE i <= (SELECT min(n) FROM (SELECT count(*) n FROM labels GROUP BY quality))""")
def balance_under(spark, sf):
    return S.undersample(table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"], "quality")


@query("balance_over", f"""
WITH s AS (SELECT quality, count(*) n FROM labels GROUP BY 1), m AS (SELECT max(n) m FROM s),
 r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_ord('doc_id')}) i FROM labels)
SELECT doc_id, quality, unnest(range(1, (m // n + (i <= m % n)::INT + 1)::BIGINT))::INT AS copy FROM r JOIN s USING (quality), m""")
def balance_over(spark, sf):
    return S.oversample(table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"], "quality")


@query("balance_before_after", """
WITH s AS (SELECT quality, count(*) n FROM labels GROUP BY 1)
SELECT 'before' AS stage, quality AS class, n FROM s UNION ALL SELECT 'after', quality, (SELECT min(n) FROM s) FROM s""")
def balance_before_after(spark, sf):
    df = table(spark, sf, "labels")
    return profile.balance_before_after(df, S.undersample(df, ["doc_id"], "quality"), "quality")


@query("class_weight", """
SELECT doc_id, round((SELECT count(*) FROM labels) / (2.0::DOUBLE * n), 8) AS weight FROM labels JOIN (SELECT quality, count(*) n FROM labels GROUP BY 1) USING (quality)""")
def class_weight(spark, sf):
    return _r(S.class_weights(table(spark, sf, "labels"), "quality").select("doc_id", "weight"), 8, "weight")


@query("cv_folds", f"""
SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_ord('o_orderkey')}) - 1) % 5)::INT AS fold FROM orders""")
def cv_folds(spark, sf):
    return S.folds(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 5, "o_orderstatus").drop("o_orderstatus")


@query("align_columns", """
SELECT p_partkey, p_size, m.med AS p_retailprice FROM part, (SELECT quantile_cont(p_retailprice, 0.5) AS med FROM part WHERE p_size < 25) m WHERE p_size >= 25""")
def align_columns(spark, sf):
    part = table(spark, sf, "part")
    train = part.filter("p_size < 25").select("p_partkey", "p_size", "p_retailprice")
    test = part.filter("p_size >= 25").select("p_size", "p_brand", "p_partkey")
    return S.align(test, train, "median")


@query("align_report", """
SELECT c AS "column", CASE WHEN c = 'p_retailprice' THEN 'filled' WHEN c = 'p_brand' THEN 'dropped' ELSE 'kept' END AS status
FROM (SELECT unnest(['p_partkey', 'p_size', 'p_retailprice', 'p_brand']) AS c) WHERE (SELECT count(*) FROM part) > 0""")
def align_report(spark, sf):
    part = table(spark, sf, "part")
    return S.align_report(part.select("p_size", "p_brand", "p_partkey"), part.select("p_partkey", "p_size", "p_retailprice"))


@query("inference_holdout", f"""
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_ord('doc_id')}) i, count(*) OVER (PARTITION BY quality) n FROM labels)
SELECT doc_id, CASE WHEN i <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split, true AS unlabelled FROM r""")
def inference_holdout(spark, sf):
    labels = table(spark, sf, "labels")
    flag = S.inference_mode(table(spark, sf, "documents"), "quality")
    out = S.inference_validation(labels, ["doc_id"], "quality", "classification")
    return out.select("doc_id", "split", F.lit(flag).alias("unlabelled"))


@query("task_detection", """
SELECT 'labels.quality' AS target, 'classification' AS task, CASE WHEN count(DISTINCT quality) = 2 THEN 'binary' ELSE 'multiclass' END AS subtask FROM labels
UNION ALL SELECT 'orders.o_orderstatus', 'classification', CASE WHEN count(DISTINCT o_orderstatus) = 2 THEN 'binary' ELSE 'multiclass' END FROM orders
UNION ALL SELECT 'orders.o_totalprice', CASE WHEN count(DISTINCT o_totalprice) > 20 THEN 'regression' ELSE 'classification' END, 'continuous' FROM orders""")
def task_detection(spark, sf):
    rows = [(f"{t}.{c}", *S.detect_task(table(spark, sf, t), c))
            for t, c in (("labels", "quality"), ("orders", "o_orderstatus"), ("orders", "o_totalprice"))]
    return spark.createDataFrame(rows, "target string, task string, subtask string")


# a score made from the text length and a second class made from its parity
_PRED = """(SELECT doc_id, quality AS y, least(n_chars / 4000.0::DOUBLE, 1.0) AS p, (n_chars > 1500)::INT AS y_hat,
 (n_chars % 3)::INT AS y3, ((n_chars // 2) % 3)::INT AS y3_hat FROM documents JOIN labels USING (doc_id))"""


def _pred(spark, sf):
    return (table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.col("quality").alias("y"), F.expr("least(n_chars / 4000.0D, 1.0D) as p"),
        F.expr("cast(n_chars > 1500 as int) as y_hat"), F.expr("cast(n_chars % 3 as int) as y3"),
        F.expr("cast((n_chars div 2) % 3 as int) as y3_hat")))


@query("metric_binary", f"""
WITH c AS (SELECT sum((y = 1 AND y_hat = 1)::INT)::DOUBLE tp, sum((y_hat = 1)::INT)::DOUBLE pp, sum((y = 1)::INT)::DOUBLE pos FROM {_PRED})
SELECT round(tp / pp, 8) AS precision, round(tp / pos, 8) AS recall, round(2 * tp / (pp + pos), 8) AS f1 FROM c""")
def metric_binary(spark, sf):
    return _r(M.binary_scores(_pred(spark, sf)), 8)


@query("metric_accuracy_logloss", f"""
SELECT round(avg((y = y_hat)::INT), 8) AS accuracy, round(-avg(ln(CASE WHEN y = 1 THEN q ELSE 1 - q END)), 8) AS log_loss
FROM (SELECT *, least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS q FROM {_PRED})""")
def metric_accuracy_logloss(spark, sf):
    df = _pred(spark, sf)
    a, l = M.accuracy(df), M.log_loss(df)
    return _r(a.select("accuracy", F.lit(l.first()[0]).alias("log_loss")), 8)


_REPORT = f"""c AS (SELECT y3 y, y3_hat h, count(*) n FROM {_PRED} GROUP BY 1, 2),
 r AS (SELECT k::VARCHAR AS label, coalesce(sum(n) FILTER (y = k AND h = k), 0)::DOUBLE AS tp, coalesce(sum(n) FILTER (h = k), 0)::DOUBLE AS pp, coalesce(sum(n) FILTER (y = k), 0)::BIGINT AS support
  FROM c, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
 s AS (SELECT label, coalesce(tp / nullif(pp, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(pp + support, 0), 0) AS f1, support FROM r)"""


@query("metric_macro_weighted", f"""
WITH {_REPORT} SELECT round(avg(precision), 8) AS precision_macro, round(avg(recall), 8) AS recall_macro, round(avg(f1), 8) AS f1_macro,
 round(sum(precision * support) / sum(support), 8) AS precision_weighted, round(sum(recall * support) / sum(support), 8) AS recall_weighted,
 round(sum(f1 * support) / sum(support), 8) AS f1_weighted FROM s""")
def metric_macro_weighted(spark, sf):
    return _r(M.averages(M.class_report(_pred(spark, sf), "y3", "y3_hat")), 8)


@query("metric_class_report", f"""
WITH {_REPORT}, a AS (SELECT * FROM s UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM s
 UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM s)
SELECT label, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, support FROM a""")
def metric_class_report(spark, sf):
    return _r(M.full_report(_pred(spark, sf), "y3", "y3_hat"), 8, "precision", "recall", "f1")


@query("metric_roc_auc", f"""
SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 8) AS roc_auc
FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rk FROM {_PRED})""")
def metric_roc_auc(spark, sf):
    return _r(M.roc_auc(_pred(spark, sf)), 8)


@query("metric_roc_curve", f"""
WITH t AS (SELECT p, sum(y) pos, sum(1 - y) neg FROM {_PRED} GROUP BY 1)
SELECT p AS threshold, round(sum(neg) OVER w / sum(neg) OVER (), 8) AS fpr, round(sum(pos) OVER w / sum(pos) OVER (), 8) AS tpr FROM t WINDOW w AS (ORDER BY p DESC)""")
def metric_roc_curve(spark, sf):
    return _r(M.roc_curve(_pred(spark, sf)), 8, "fpr", "tpr")


_MCC = """(n * tp - sum_tp) / sqrt((n * n - pp) * (n * n - tt))"""


@query("metric_matthews", f"""
WITH c AS (SELECT y3 y, y3_hat h, count(*)::DOUBLE n FROM {_PRED} GROUP BY 1, 2), t AS (SELECT y k, sum(n) t FROM c GROUP BY 1), p AS (SELECT h k, sum(n) p FROM c GROUP BY 1),
 x AS (SELECT sum(t * p) sum_tp, sum(t * t) tt, sum(p * p) pp FROM t JOIN p USING (k)), o AS (SELECT sum(n) n, sum(n) FILTER (y = h) tp FROM c)
SELECT round({_MCC}, 8) AS mcc FROM x, o""")
def metric_matthews(spark, sf):
    return _r(M.matthews(_pred(spark, sf), "y3", "y3_hat"), 8)


@query("metric_confusion", f"SELECT y3 AS y, y3_hat AS y_hat, count(*) AS n FROM {_PRED} GROUP BY 1, 2")
def metric_confusion(spark, sf):
    return M.confusion(_pred(spark, sf), "y3", "y3_hat")


@query("metric_confusion_wide", f"""
SELECT y3 AS y, count(*) FILTER (y3_hat = 0) AS "0", count(*) FILTER (y3_hat = 1) AS "1", count(*) FILTER (y3_hat = 2) AS "2" FROM {_PRED} GROUP BY 1""")
def metric_confusion_wide(spark, sf):
    return M.confusion_wide(_pred(spark, sf), [0, 1, 2], "y3", "y3_hat")


_REG = "(SELECT l_extendedprice AS y, l_quantity * 1500 AS y_hat FROM lineitem)"


def _reg(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("y_hat"))


@query("metric_regression", f"""
SELECT round(1 - avg(pow(y - y_hat, 2)) / var_pop(y), 7) AS r2, round(avg(abs(y - y_hat)), 4) AS mae, round(avg(pow(y - y_hat, 2)), 0) AS mse,
 round(sqrt(avg(pow(y - y_hat, 2))), 4) AS rmse, round(avg(abs(y - y_hat) / greatest(abs(y), 2.220446049250313e-16)), 7) AS mape,
 round(avg(2 * abs(y - y_hat) / (abs(y) + abs(y_hat))), 7) AS smape FROM {_REG}""")
def metric_regression(spark, sf):
    m = M.regression_scores(_reg(spark, sf))
    return _r(_r(_r(m, 7, "r2", "mape", "smape"), 4, "mae", "rmse"), 0, "mse")


@query("metric_forecast", f"""
SELECT round(avg(2 * abs(y - y_hat) / (abs(y) + abs(y_hat))), 7) AS smape, round(avg(abs(y - y_hat) / greatest(abs(y), 2.220446049250313e-16)), 7) AS mape,
 round(sqrt(avg(pow(y - y_hat, 2))), 4) AS rmse, round(avg(abs(y - y_hat)), 4) AS mae FROM {_REG}""")
def metric_forecast(spark, sf):
    return _r(_r(M.forecast_scores(_reg(spark, sf)), 7, "smape", "mape"), 4, "mae", "rmse")


@query("metric_residual_histogram", f"""
WITH d AS (SELECT y - y_hat AS x FROM {_REG}), s AS (SELECT min(x) lo, max(x) hi FROM d)
SELECT least(floor((x - lo) / ((hi - lo) / 30)), 29)::BIGINT AS bin, count(*) AS n FROM d, s GROUP BY 1""")
def metric_residual_histogram(spark, sf):
    return M.residual_histogram(_reg(spark, sf)).select("bin", "n")


@query("metric_residuals", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS y, l_quantity * 1500 AS y_hat, l_extendedprice - l_quantity * 1500 AS residual FROM lineitem""")
def metric_residuals(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("y_hat"))
    return M.residuals(df)


@query("metric_compare_models", f"""
WITH d AS (SELECT y, y_hat a, (p > 0.5)::INT b FROM {_PRED})
SELECT 'long_text' AS model, 'accuracy' AS metric, round(avg((y = a)::INT), 8) AS value FROM d UNION ALL SELECT 'half_score', 'accuracy', round(avg((y = b)::INT), 8) FROM d""")
def metric_compare_models(spark, sf):
    df = _pred(spark, sf).withColumn("b", (F.col("p") > 0.5).cast("int"))
    table_ = M.compare_models({"long_text": M.accuracy(df), "half_score": M.accuracy(df, "y", "b")})
    return _r(M.long_metrics(table_), 8, "value")


@query("metric_clustering", """
WITH d AS (SELECT l_returnflag k, l_quantity a, l_tax * 100 b FROM lineitem), m AS (SELECT avg(a) a, avg(b) b, count(*) n FROM d),
 c AS (SELECT k, avg(a) a, avg(b) b, count(*) n FROM d GROUP BY 1),
 w AS (SELECT d.k, sum(pow(d.a - c.a, 2) + pow(d.b - c.b, 2)) w, avg(sqrt(pow(d.a - c.a, 2) + pow(d.b - c.b, 2))) s FROM d JOIN c ON d.k = c.k GROUP BY 1),
 ch AS (SELECT (sum(c.n * (pow(c.a - m.a, 2) + pow(c.b - m.b, 2))) / 2) / ((SELECT sum(w) FROM w) / (max(m.n) - 3)) v FROM c, m),
 db AS (SELECT avg(r) v FROM (SELECT x.k, max((wx.s + wy.s) / sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2))) r FROM c x JOIN c y ON x.k <> y.k JOIN w wx ON wx.k = x.k JOIN w wy ON wy.k = y.k GROUP BY 1))
SELECT round(ch.v, 4) AS calinski_harabasz, round(db.v, 3) AS davies_bouldin FROM ch, db""")
def metric_clustering(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_tax") * 100).alias("tax"))
    m = M.clustering_scores(df, ["l_quantity", "tax"], "l_returnflag")
    return _r(_r(m, 4, "calinski_harabasz"), 3, "davies_bouldin")


@query("score_exported_predictions", """
SELECT doc_id, (n_chars > 1500)::INT AS y_hat, quality AS y, ((n_chars > 1500)::INT = quality)::INT AS correct FROM documents JOIN labels USING (doc_id)""")
def score_exported_predictions(spark, sf):
    pred = table(spark, sf, "documents").select("doc_id", F.expr("cast(n_chars > 1500 as int) as y_hat"))
    return M.score_predictions(pred, table(spark, sf, "labels"), "doc_id", "quality")
