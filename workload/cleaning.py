from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import clean as C, series as S
from workload.registry import query, table

# every seventh value is missing
_GAPS = "(SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)"


def _gaps(spark, sf):
    return (table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type",
                                              F.expr("if(event_id % 7 = 0, null, value) as value")))


def _r(df, digits=6, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("clean_null_tokens", """
SELECT event_id, CASE WHEN event_type NOT IN ('error', '42') THEN event_type END AS event_type,
 CASE WHEN user_id <> 42 THEN user_id END AS user_id FROM events""")
def clean_null_tokens(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    return C.null_representations(df, ["event_type", "user_id"], "error, 42")


@query("clean_suggestions", """
SELECT 'event_id' AS "column", 0.0::DOUBLE AS pct_miss, 'none' AS action UNION ALL SELECT 'event_type', 0.0, 'none'
UNION ALL SELECT 'value', (count(*) - count(value)) * 100.0::DOUBLE / count(*), CASE WHEN (count(*) - count(value)) * 100.0 / count(*) > 50 THEN 'drop_column'
 WHEN (count(*) - count(value)) * 100.0 / count(*) < 5 THEN 'drop_rows' ELSE 'median' END FROM """ + _GAPS)
def clean_suggestions(spark, sf):
    return C.suggest_actions(_gaps(spark, sf).select("event_id", "event_type", "value"))


@query("clean_drop_rows_then_mean", f"""
WITH d AS (SELECT event_id, value, CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS user_id FROM {_GAPS} WHERE value IS NOT NULL)
SELECT event_id, value, round(coalesce(user_id, (SELECT avg(user_id) FROM d)), 6) AS user_id FROM d""")
def clean_drop_rows_then_mean(spark, sf):
    df = _gaps(spark, sf).select("event_id", "value", F.expr("if(event_id % 11 = 0, null, user_id) as user_id"))
    return _r(C.clean(df, {"value": "drop_rows", "user_id": "mean"}), 6, "user_id")


@query("clean_drop_column", "SELECT event_id, event_type FROM events")
def clean_drop_column(spark, sf):
    return C.clean(_gaps(spark, sf).select("event_id", "event_type", "value"), {"value": "drop_column"})


@query("clean_mean_median", f"""
SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM {_GAPS})), 6) AS value,
 coalesce(other, (SELECT quantile_cont(CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END, 0.5) FROM events)) AS other
FROM (SELECT event_id, value, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END::DOUBLE AS other FROM {_GAPS})""")
def clean_mean_median(spark, sf):
    df = _gaps(spark, sf).select("event_id", "value", F.expr("cast(if(event_id % 3 = 0, null, user_id) as double) as other"))
    return _r(C.clean(df, {"value": "mean", "other": "median"}), 6, "value")


@query("clean_mode", """
WITH d AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END t,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END u FROM events)
SELECT event_id, coalesce(t, (SELECT t FROM d WHERE t IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS t,
 coalesce(u, (SELECT u FROM d WHERE u IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS u FROM d""")
def clean_mode(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.expr("if(event_id % 5 = 0, null, event_type) as t"),
                                           F.expr("if(event_id % 4 = 0, null, user_id) as u"))
    return C.clean(df, {"t": "mode", "u": "most_frequent"})


@query("clean_zero_constant_flag", f"""
SELECT event_id, coalesce(value, 0) AS zero, coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END, 'MISSING') AS label,
 coalesce(value, 0) AS value, (value IS NULL)::INT AS value_missing FROM {_GAPS}""")
def clean_zero_constant_flag(spark, sf):
    df = _gaps(spark, sf).select("event_id", F.col("value").alias("zero"),
                                 F.expr("if(event_id % 5 = 0, null, event_type) as label"), "value")
    return C.clean(df, {"zero": "zero", "label": "constant", "value": "flag_zero"})


_FILLED = f"""SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS forward,
 first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward
FROM {_GAPS}"""


def _fills(df, **kw):
    both = df.withColumns({"forward": F.col("value"), "backward": F.col("value")})
    out = S.fill(both, ["forward"], ["ts", "event_id"], ["user_id"], "forward", **kw)
    return S.fill(out, ["backward"], ["ts", "event_id"], ["user_id"], "backward", **kw).select(
        "event_id", "user_id", "forward", "backward")


@query("fill_forward_backward", _FILLED)
def fill_forward_backward(spark, sf):
    return _fills(_gaps(spark, sf))


@query("fill_forward_blocks", _FILLED)
def fill_forward_blocks(spark, sf):
    """The same result with groups cut into 40-row blocks, the path that large groups take."""
    return _fills(_gaps(spark, sf), block_rows=40)


@query("fill_limited", f"""
SELECT event_id, coalesce(value, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
 ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) AS value FROM (SELECT event_id, ts, user_id, CASE WHEN event_id % 3 > 0 THEN NULL ELSE value END AS value FROM events)""")
def fill_limited(spark, sf):
    df = table(spark, sf, "events").select("event_id", "ts", "user_id", F.expr("if(event_id % 3 > 0, null, value) as value"))
    return S.fill(df, ["value"], ["ts", "event_id"], ["user_id"], limit=1).select("event_id", "value")


def _interp_sql(pos: str) -> str:
    w = "PARTITION BY user_id ORDER BY ts, event_id"
    return f"""
WITH d AS (SELECT *, {pos} AS p FROM {_GAPS}),
 n AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER ({w}) pb,
  last_value(value IGNORE NULLS) OVER ({w}) vb,
  first_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) pa,
  first_value(value IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) va FROM d)
SELECT event_id, round(CASE WHEN value IS NOT NULL THEN value WHEN vb IS NULL THEN NULL WHEN va IS NULL THEN vb
 ELSE vb + (va - vb) * coalesce((p - pb) * 1.0::DOUBLE / nullif(pa - pb, 0), 0) END, 6) AS value FROM n"""


@query("interpolate_position", _interp_sql("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)"))
def interpolate_position(spark, sf):
    return _r(S.interpolate(_gaps(spark, sf), "value", ["ts", "event_id"], ["user_id"]).select("event_id", "value"), 6, "value")


@query("interpolate_time", _interp_sql("epoch_us(ts) / 1e6"))
def interpolate_time(spark, sf):
    out = S.interpolate(_gaps(spark, sf), "value", ["ts", "event_id"], ["user_id"], time="ts", block_rows=40)
    return _r(out.select("event_id", "value"), 6, "value")


_W = "PARTITION BY user_id ORDER BY ts, event_id"


@query("rolling_means", "SELECT event_id, " + ", ".join(
    f"""CASE WHEN count(*) OVER ({_W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) = {w}
 THEN round(avg(value) OVER ({_W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 6) END AS value_ma{w}""" for w in (3, 7, 14))
       + f" FROM {_GAPS} WHERE value IS NOT NULL")
def rolling_means(spark, sf):
    out = S.rolling_mean(_gaps(spark, sf), "value", ["ts", "event_id"], ["user_id"], [3, 7, 14])
    return _r(out.select("event_id", "value_ma3", "value_ma7", "value_ma14"), 6, "value_ma3", "value_ma7", "value_ma14")


@query("rolling_mean_whole_series", """
SELECT event_id, CASE WHEN count(*) OVER (ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7
 THEN round(avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) END AS value_ma7 FROM events""")
def rolling_mean_whole_series(spark, sf):
    """One series without a key, always in blocks."""
    out = S.rolling_mean(table(spark, sf, "events"), "value", ["ts", "event_id"], [], [7], block_rows=1000)
    return _r(out.select("event_id", "value_ma7"), 6, "value_ma7")


@query("lag_features", f"""
SELECT event_id, lag(value, 1) OVER ({_W}) AS value_lag1, lag(value, 2) OVER ({_W}) AS value_lag2,
 lag(value, 3) OVER ({_W}) AS value_lag3 FROM events""")
def lag_features(spark, sf):
    out = S.lags(table(spark, sf, "events"), "value", ["ts", "event_id"], ["user_id"])
    return out.select("event_id", "value_lag1", "value_lag2", "value_lag3")


@query("autocorrelation", f"""
SELECT round(corr(y, y_lag), 8) AS r, count(*) AS n FROM (SELECT value AS y, lead(value, 5) OVER ({_W}) AS y_lag FROM {_GAPS})
WHERE y IS NOT NULL AND y_lag IS NOT NULL""")
def autocorrelation(spark, sf):
    return _r(S.autocorrelation(_gaps(spark, sf), "value", ["ts", "event_id"], 5, ["user_id"]), 8, "r")


@query("autocorrelation_pairs", f"""
SELECT event_id, y, y_lag FROM (SELECT event_id, value AS y, lead(value, 2) OVER ({_W}) AS y_lag FROM {_GAPS})
WHERE y IS NOT NULL AND y_lag IS NOT NULL""")
def autocorrelation_pairs(spark, sf):
    return S.autocorrelation_pairs(_gaps(spark, sf), "value", ["ts", "event_id"], 2, ["user_id"], block_rows=40).select(
        "event_id", "y", "y_lag")


@query("seasonal_box", """
WITH d AS (SELECT month(o_orderdate)::INT AS m, o_totalprice x FROM orders),
 q AS (SELECT m, quantile_cont(x, 0.25) q1, quantile_cont(x, 0.5) q2, quantile_cont(x, 0.75) q3 FROM d GROUP BY 1)
SELECT d.m AS month, count(*) AS n, round(max(q1), 4) AS q1, round(max(q2), 4) AS median, round(max(q3), 4) AS q3,
 min(x) FILTER (x >= q1 - 1.5 * (q3 - q1)) AS low, max(x) FILTER (x <= q3 + 1.5 * (q3 - q1)) AS high,
 count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers FROM d JOIN q ON d.m = q.m GROUP BY 1""")
def seasonal_box(spark, sf):
    return _r(S.seasonal_box(table(spark, sf, "orders"), "o_totalprice", "o_orderdate"), 4, "q1", "median", "q3")


@query("series_points", """
WITH d AS (SELECT ts, value, floor(epoch(ts))::BIGINT s FROM events), b AS (SELECT min(s) lo, max(s) hi FROM d)
SELECT least(floor((s - lo) / ((hi - lo) / 50.0::DOUBLE)), 49)::BIGINT AS bucket, min(ts) AS t, round(avg(value), 6) AS y, count(*) AS n FROM d, b GROUP BY 1""")
def series_points(spark, sf):
    return _r(S.series_points(table(spark, sf, "events"), "ts", "value", 50), 6, "y")


@query("seasonal_decompose", f"""
WITH d AS (SELECT event_id, user_id, ts, value AS y, (row_number() OVER ({_W}) - 1) % 12 AS phase,
  CASE WHEN count(*) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN
   (sum(value) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) - (lag(value, 6) OVER ({_W}) + lead(value, 6) OVER ({_W})) / 2) / 12 END AS trend FROM events),
 p AS (SELECT user_id, phase, avg(y - trend) AS s FROM d GROUP BY 1, 2),
 q AS (SELECT user_id, phase, s - avg(s) OVER (PARTITION BY user_id) AS seasonal FROM p)
SELECT event_id, round(trend, 9) AS trend, round(seasonal, 9) AS seasonal, round(y - trend - seasonal, 9) AS residual
FROM d JOIN q USING (user_id, phase)""")
def seasonal_decompose(spark, sf):
    out = S.seasonal_decompose(table(spark, sf, "events"), "value", ["ts", "event_id"], ["user_id"])
    return _r(out.select("event_id", "trend", "seasonal", "residual"), 9, "trend", "seasonal", "residual")


_FENCE = """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) q1, quantile_cont(o_totalprice, 0.75) q3 FROM orders),
 f AS (SELECT q1 - 0.4 * (q3 - q1) lo, q3 + 0.4 * (q3 - q1) hi FROM q)"""


@query("outlier_clip", _FENCE + " SELECT o_orderkey, round(least(greatest(o_totalprice, lo), hi), 4) AS o_totalprice FROM orders, f")
def outlier_clip(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return _r(C.clip(df, C.fit_fences(df, ["o_totalprice"], 0.4)), 4, "o_totalprice")


@query("outlier_zscore", """
WITH s AS (SELECT avg(value) m, stddev_samp(value) sd FROM events)
SELECT event_id, value FROM events, s WHERE abs((value - m) / sd) <= 3""")
def outlier_zscore(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return C.drop_zscore(df, C.fit_zscore(df, ["value"]))


@query("outlier_flag", """
WITH q AS (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM events)
SELECT event_id, (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))::INT AS value_is_outlier FROM events, q""")
def outlier_flag(spark, sf):
    df = table(spark, sf, "events")
    return C.flag_outliers(df, C.fit_fences(df, ["value"])).select("event_id", "value_is_outlier")


@query("outlier_report", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS "column", count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers,
 count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) * 1.0::DOUBLE / count({c}) AS ratio
FROM lineitem, (SELECT quantile_cont({c}, 0.25) q1, quantile_cont({c}, 0.75) q3 FROM lineitem)""" for c in ("l_extendedprice", "l_quantity")))
def outlier_report(spark, sf):
    df = table(spark, sf, "lineitem")
    return C.outlier_report(df, C.fit_fences(df, ["l_extendedprice", "l_quantity"]))


@query("outlier_clip_percentile", """
WITH q AS (SELECT quantile_cont(value, 0.01) lo, quantile_cont(value, 0.99) hi FROM events)
SELECT event_id, round(least(greatest(value, lo), hi), 6) AS value FROM events, q""")
def outlier_clip_percentile(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return _r(C.clip(df, C.fit_percentile_fences(df, ["value"])), 6, "value")


@query("outlier_drop_outside_fence", _FENCE + " SELECT o_orderkey, o_totalprice FROM orders, f WHERE o_totalprice BETWEEN lo AND hi")
def outlier_drop_outside_fence(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return C.drop_outside(df, C.fit_fences(df, ["o_totalprice"], 0.4))


@query("outlier_winsorize", """
WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY value) i, count(*) OVER () n FROM events WHERE value IS NOT NULL),
 b AS (SELECT max(value) FILTER (i = floor(0.05 * n) + 1) lo, max(value) FILTER (i = n - floor(0.05 * n)) hi FROM r)
SELECT event_id, round(least(greatest(value, lo), hi), 6) AS value FROM events, b""")
def outlier_winsorize(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return _r(C.clip(df, C.fit_winsor(df, ["value"])), 6, "value")


def _dup_sql(where: str) -> str:
    return f"""SELECT doc_id, lang, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS f,
 row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS l, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE {where}"""


def _dedup(spark, sf, keep):
    df = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return C.drop_duplicates(df, ["doc_id"], ["text"], keep).select("doc_id", "lang", F.md5("text").alias("digest"))


@query("dedup_keep_first", _dup_sql("f = 1"))
def dedup_keep_first(spark, sf):
    return _dedup(spark, sf, "first")


@query("dedup_keep_last", _dup_sql("l = 1"))
def dedup_keep_last(spark, sf):
    return _dedup(spark, sf, "last")


@query("dedup_drop_all", _dup_sql("n = 1"))
def dedup_drop_all(spark, sf):
    return _dedup(spark, sf, "none")


@query("dedup_flag", """
SELECT doc_id, (row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1)::INT AS is_duplicate FROM documents""")
def dedup_flag(spark, sf):
    return C.flag_duplicates(table(spark, sf, "documents"), ["doc_id"], ["text"]).select("doc_id", "is_duplicate")


@query("outliers_before_or_after_encoding", """
WITH q AS (SELECT quantile_cont(p_size, 0.25)::DOUBLE q1, quantile_cont(p_size, 0.75)::DOUBLE q3 FROM part),
 c AS (SELECT p_partkey, least(greatest(p_size::DOUBLE, q1 - 0.2 * (q3 - q1)), q3 + 0.2 * (q3 - q1)) x FROM part, q),
 z AS (SELECT p_partkey, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () s FROM part),
 zq AS (SELECT quantile_cont(s, 0.25) q1, quantile_cont(s, 0.75) q3 FROM z)
SELECT p_partkey, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) AS before_encoding,
 round(least(greatest(s, zq.q1 - 0.2 * (zq.q3 - zq.q1)), zq.q3 + 0.2 * (zq.q3 - zq.q1)), 6) AS after_encoding FROM c JOIN z USING (p_partkey), zq""")
def outliers_before_or_after_encoding(spark, sf):
    from millrace.operators import scale
    df = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("before_encoding"),
                                         F.col("p_size").cast("double").alias("after_encoding"))
    out = C.clip(df, C.fit_fences(df, ["before_encoding"], 0.2))
    out = scale.apply_scaler(out, scale.standard_expr, scale.fit_moments(out, ["before_encoding", "after_encoding"]))
    out = C.clip(out, C.fit_fences(out, ["after_encoding"], 0.2))
    return _r(out, 6, "before_encoding", "after_encoding")
