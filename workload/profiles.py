from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import predicates as P
from millrace.operators import charts, correlate, profile
from millrace.plans.parallel import widened
from workload.registry import query, table


def _kind_sql(t: str, cols: dict[str, str]) -> str:
    """Kind and distinct count per column; ``cols`` maps a column to num, text or time."""
    parts = []
    for c, k in cols.items():
        u, n = f"count(DISTINCT {c})", f"count({c})"
        if k == "time":
            kind = "'datetime'"
        elif k == "num":
            kind = (f"CASE WHEN {u} = 2 THEN 'binary' WHEN {u} * 1.0 / {n} > 0.95 AND {u} > 50 THEN 'id_like' "
                    "ELSE 'numeric' END")
        else:
            kind = (f"CASE WHEN {u} = 2 THEN 'binary' WHEN {u} * 1.0 / {n} > 0.90 AND avg(length({c})) > 20 THEN 'text' "
                    f"WHEN {u} * 1.0 / {n} > 0.95 AND {u} > 50 THEN 'id_like' ELSE 'categorical' END")
        parts.append(f"""SELECT '{c}' AS "column", {kind} AS kind, {u} AS n_unique, count(*) - {n} AS missing,
 (count(*) - {n}) * 100.0 / count(*) AS pct_miss FROM {t}""")
    return "\nUNION ALL\n".join(parts)


_LINE = {"l_orderkey": "num", "l_partkey": "num", "l_suppkey": "num", "l_linenumber": "num", "l_quantity": "num",
         "l_extendedprice": "num", "l_discount": "num", "l_tax": "num", "l_returnflag": "text",
         "l_linestatus": "text", "l_shipdate": "time"}


def _kinds(df):
    return profile.column_metadata(df).select("column", "kind", "n_unique", "missing", "pct_miss")


@query("profile_kinds_lineitem", _kind_sql("lineitem", _LINE).replace("* 100.0", "* 100.0::DOUBLE"))
def profile_kinds_lineitem(spark, sf):
    return _kinds(widened(table(spark, sf, "lineitem")))


@query("profile_kinds_documents", _kind_sql("documents", {
    "doc_id": "num", "text": "text", "lang": "text", "source": "text", "n_chars": "num"}).replace("* 100.0", "* 100.0::DOUBLE"))
def profile_kinds_documents(spark, sf):
    return _kinds(table(spark, sf, "documents"))


@query("profile_kinds_simple", """
SELECT 'o_orderkey' AS "column", 'id_like' AS kind FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderkey) * 1.0 / count(*) > 0.95
UNION ALL SELECT 'o_custkey', CASE WHEN count(DISTINCT o_custkey) * 1.0 / count(*) > 0.95 THEN 'id_like' ELSE 'numeric' END FROM orders
UNION ALL SELECT 'o_orderstatus', CASE WHEN count(DISTINCT o_orderstatus) >= 100 THEN 'text' ELSE 'categorical' END FROM orders
UNION ALL SELECT 'o_totalprice', CASE WHEN count(DISTINCT o_totalprice) * 1.0 / count(*) > 0.95 THEN 'id_like' ELSE 'numeric' END FROM orders
UNION ALL SELECT 'o_orderdate', 'datetime'
UNION ALL SELECT 'o_orderpriority', CASE WHEN count(DISTINCT o_orderpriority) >= 100 THEN 'text' ELSE 'categorical' END FROM orders""")
def profile_kinds_simple(spark, sf):
    return profile.column_kinds(table(spark, sf, "orders"), rule="simple")


def _describe_sql(t, cols):
    return "\nUNION ALL\n".join(f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 5) AS mean,
 round(stddev_samp({c}), 5) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 5)::DOUBLE AS q25,
 round(quantile_cont({c}, 0.5), 5)::DOUBLE AS q50, round(quantile_cont({c}, 0.75), 5)::DOUBLE AS q75, max({c})::DOUBLE AS max FROM {t}"""
                                 for c in cols)


def _rounded(df, cols, digits=5):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("profile_describe_numeric", _describe_sql("lineitem", [
    "l_quantity::DOUBLE", "l_extendedprice", "l_discount", "l_tax"]).replace("'l_quantity::DOUBLE'", "'l_quantity'"))
def profile_describe_numeric(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    d = profile.describe_numeric(table(spark, sf, "lineitem"), cols)
    return _rounded(d, ["mean", "std", "q25", "q50", "q75"])


def _cat_sql(t, cols):
    return "\nUNION ALL\n".join(f"""SELECT '{c}' AS "column", sum(n)::BIGINT AS count, count(*) AS "unique",
 arg_min(v, (-n, v)) AS top, max(n) AS freq FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1)"""
                                 for c in cols)


@query("profile_describe_categorical", _cat_sql("orders", ["o_orderstatus", "o_orderpriority", "o_custkey"]))
def profile_describe_categorical(spark, sf):
    return profile.describe_categorical(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query("profile_missing", """
SELECT * FROM (SELECT 'value' AS "column", count(*) - count(v) AS missing, (count(*) - count(v)) * 100.0::DOUBLE / count(*) AS pct
 FROM (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)
UNION ALL SELECT 'event_type', count(*) - count(v), (count(*) - count(v)) * 100.0::DOUBLE / count(*)
 FROM (SELECT CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS v FROM events)) WHERE missing > 0""")
def profile_missing(spark, sf):
    return profile.missing_report(table(spark, sf, "events").withColumns({
        "value": F.expr("if(event_id % 7 = 0, null, value)"), "event_type": F.expr("if(event_id % 5 = 0, null, event_type)")}))


@query("hist_price", """
WITH s AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders)
SELECT bin, round(lo + bin * ((hi - lo) / 30), 4) AS "left", n FROM (
 SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 30)), 29)::BIGINT AS bin, count(*) AS n FROM orders, s GROUP BY 1), s""")
def hist_price(spark, sf):
    return charts.histogram(table(spark, sf, "orders"), "o_totalprice").select("bin", F.round("left", 4).alias("left"), "n")


@query("hist_log_by_hue", """
WITH d AS (SELECT l_returnflag, log10(l_extendedprice) AS x FROM lineitem WHERE l_extendedprice > 0),
 s AS (SELECT min(x) lo, max(x) hi FROM d)
SELECT l_returnflag, least(floor((x - lo) / ((hi - lo) / 20)), 19)::BIGINT AS bin, count(*) AS n FROM d, s GROUP BY 1, 2""")
def hist_log_by_hue(spark, sf):
    return charts.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 20, "l_returnflag", log=True).select(
        "l_returnflag", "bin", "n")


_KDE = """
WITH d AS ({data}), s AS (SELECT min(x) lo, max(x) hi FROM d),
 c AS (SELECT h, b, count(*) n, sum(x) sx, sum(x * x) sx2 FROM (SELECT h, x,
   least(floor((x - lo) / ((hi - lo) / 4096)), 4095) AS b FROM d, s) GROUP BY 1, 2),
 t AS (SELECT h, sum(n) n, sqrt((sum(sx2) - sum(sx) * sum(sx) / sum(n)) / (sum(n) - 1)) * pow(sum(n), -0.2) AS bw FROM c GROUP BY 1),
 g AS (SELECT unnest(range(0, 200)) AS i)
SELECT {hue} i, density FROM (SELECT c.h, g.i, round(sum(c.n * exp(-0.5 * pow((lo + g.i * ((hi - lo) / 199) - (lo + (b + 0.5) * ((hi - lo) / 4096))) / bw, 2))
 / (t.n * bw * sqrt(2 * pi()))) * {scale}, 6) AS density FROM c JOIN t ON c.h IS NOT DISTINCT FROM t.h, s, g GROUP BY 1, 2)"""


def _kde_points(df, lo_hi, scale, keys=()):
    lo, hi = lo_hi
    step = (hi - lo) / 199
    return df.select(*keys, F.round((F.col("x") - lo) / step).cast("long").alias("i"),
                     F.round(F.col("density") * scale, 6).alias("density"))


@query("kde_price", _KDE.format(data="SELECT 'all' AS h, o_totalprice AS x FROM orders", hue="", scale="1e5"))
def kde_price(spark, sf):
    df = table(spark, sf, "orders")
    (lo, hi), = charts.span(df, F.col("o_totalprice"))
    return _kde_points(charts.density(df, "o_totalprice"), (lo, hi), 1e5)


@query("kde_by_hue", _KDE.format(data="SELECT event_type AS h, value AS x FROM events", hue="h AS event_type,", scale="1e2"))
def kde_by_hue(spark, sf):
    df = table(spark, sf, "events")
    (lo, hi), = charts.span(df, F.col("value"))
    return _kde_points(charts.density(df, "value", "event_type"), (lo, hi), 1e2, ["event_type"])


_BOX = """
WITH q AS (SELECT o_orderpriority g, quantile_cont(o_totalprice, 0.25) q1, quantile_cont(o_totalprice, 0.5) q2,
 quantile_cont(o_totalprice, 0.75) q3 FROM orders GROUP BY 1)
SELECT g AS o_orderpriority, count(*) AS n, round(max(q1), 4) AS q1, round(max(q2), 4) AS median, round(max(q3), 4) AS q3,
 min(o_totalprice) FILTER (o_totalprice >= q1 - 1.5 * (q3 - q1)) AS low,
 max(o_totalprice) FILTER (o_totalprice <= q3 + 1.5 * (q3 - q1)) AS high,
 count(*) FILTER (o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AS outliers
FROM orders JOIN q ON o_orderpriority = g GROUP BY g"""


@query("box_price_by_priority", _BOX)
def box_price_by_priority(spark, sf):
    return _rounded(charts.box(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority"), ["q1", "median", "q3"], 4)


@query("box_overall", """
WITH q AS (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.5) q2, quantile_cont(value, 0.75) q3 FROM events)
SELECT count(*) AS n, round(max(q1), 4) AS q1, round(max(q2), 4) AS median, round(max(q3), 4) AS q3,
 min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS low, max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS high,
 count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers FROM events, q""")
def box_overall(spark, sf):
    return _rounded(charts.box(table(spark, sf, "events"), "value"), ["q1", "median", "q3"], 4)


@query("violin_value")
def violin_value(spark, sf):
    return charts.violin(table(spark, sf, "events"), "value", "event_type", points=50)


@query("top_sources", """
SELECT source AS value, count(*) AS n, count(*) * 1.0::DOUBLE / (SELECT count(source) FROM documents) AS share
FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10""")
def top_sources(spark, sf):
    return profile.top_values(table(spark, sf, "documents"), "source")


@query("crosstab_counts", """
SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS share
FROM orders GROUP BY 1, 2""")
def crosstab_counts(spark, sf):
    return charts.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", normalise=True)


@query("crosstab_top_wide", """
WITH b AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)
SELECT p_brand, count(*) FILTER (p_type = 'ECONOMY') AS "ECONOMY", count(*) FILTER (p_type = 'STANDARD') AS "STANDARD",
 count(*) FILTER (p_type = 'PROMO') AS "PROMO" FROM part JOIN b USING (p_brand) GROUP BY 1""")
def crosstab_top_wide(spark, sf):
    wide = charts.crosstab(table(spark, sf, "part"), "p_brand", "p_type", 10, wide=True)
    return wide.select("p_brand", "ECONOMY", "STANDARD", "PROMO")


@query("scatter_sample", """
SELECT c_custkey, c_acctbal, c_nationkey FROM customer ORDER BY md5(concat_ws('#', c_custkey, '42')) LIMIT 1000""")
def scatter_sample(spark, sf):
    return charts.scatter(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], ["c_custkey"], 1000)


@query("pair_plot_rows", "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL")
def pair_plot_rows(spark, sf):
    return charts.pair_plot(table(spark, sf, "part"), ["p_size", "p_retailprice"], ["p_partkey"])


_HIST2D = """
WITH s AS (SELECT min(l_quantity) x0, max(l_quantity) x1, min(l_extendedprice) y0, max(l_extendedprice) y1 FROM lineitem)
SELECT least(floor((l_quantity - x0) / ((x1 - x0) / 30)), 29)::BIGINT AS bx,
 least(floor((l_extendedprice - y0) / ((y1 - y0) / 30)), 29)::BIGINT AS "by", count(*) AS n FROM lineitem, s GROUP BY 1, 2"""


@query("hist2d_quantity_price", _HIST2D)
def hist2d_quantity_price(spark, sf):
    return charts.hist2d(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query("hexbin_quantity_price", """
WITH s AS (SELECT min(l_quantity) x0, (max(l_quantity) - min(l_quantity)) / 30 sx, min(l_extendedprice) y0,
  (max(l_extendedprice) - min(l_extendedprice)) / 17 sy FROM lineitem),
 d AS (SELECT (l_quantity - x0) / sx u, (l_extendedprice - y0) / sy v FROM lineitem, s),
 h AS (SELECT CASE WHEN pow(u - floor(u + 0.5), 2) + 3.0 * pow(v - floor(v + 0.5), 2) < pow(u - floor(u) - 0.5, 2) + 3.0 * pow(v - floor(v) - 0.5, 2)
   THEN floor(u + 0.5) ELSE floor(u) + 0.5 END a,
  CASE WHEN pow(u - floor(u + 0.5), 2) + 3.0 * pow(v - floor(v + 0.5), 2) < pow(u - floor(u) - 0.5, 2) + 3.0 * pow(v - floor(v) - 0.5, 2)
   THEN floor(v + 0.5) ELSE floor(v) + 0.5 END b FROM d)
SELECT round(x0 + a * sx, 4) AS hx, round(y0 + b * sy, 3) AS hy, n FROM (SELECT a, b, count(*) n FROM h GROUP BY 1, 2), s""")
def hexbin_quantity_price(spark, sf):
    return charts.hexbin(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select(
        F.round("hx", 4).alias("hx"), F.round("hy", 3).alias("hy"), "n")


@query("kde2d_quantity_price")
def kde2d_quantity_price(spark, sf):
    return charts.density2d(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]]


@query("corr_pearson", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 7) AS r FROM lineitem" for a, b in _PAIRS))
def corr_pearson(spark, sf):
    return _rounded(correlate.pearson(table(spark, sf, "lineitem"), _CORR_COLS), ["r"], 7)


def _rank_sql(t, a, b):
    return f"""SELECT '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 7) AS r FROM (SELECT
 rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
 rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM {t})"""


@query("corr_spearman", "\nUNION ALL\n".join([_rank_sql("part", "p_size", "p_retailprice"),
                                               _rank_sql("part", "p_partkey", "p_size")]))
def corr_spearman(spark, sf):
    df = table(spark, sf, "part")
    both = correlate.spearman(df, ["p_size", "p_retailprice"]).unionByName(correlate.spearman(df, ["p_partkey", "p_size"]))
    return _rounded(both, ["r"], 7)


@query("corr_kendall", """
WITH c AS (SELECT l_quantity x, l_linenumber y, count(*)::DOUBLE n FROM lineitem GROUP BY 1, 2),
 p AS (SELECT sum(a.n * b.n * sign((a.x - b.x) * (a.y - b.y))) / 2 AS s FROM c a, c b),
 tx AS (SELECT sum(n * (n - 1) / 2) t FROM (SELECT sum(n) n FROM c GROUP BY x)),
 ty AS (SELECT sum(n * (n - 1) / 2) t FROM (SELECT sum(n) n FROM c GROUP BY y)),
 tot AS (SELECT sum(n) * (sum(n) - 1) / 2 n0 FROM c)
SELECT 'l_quantity' AS a, 'l_linenumber' AS b, round(s / sqrt((n0 - tx.t) * (n0 - ty.t)), 7) AS r FROM p, tx, ty, tot""")
def corr_kendall(spark, sf):
    return _rounded(correlate.kendall(table(spark, sf, "lineitem"), ["l_quantity", "l_linenumber"]), ["r"], 7)


@query("target_analysis_box", """
WITH q AS (SELECT c_mktsegment g, quantile_cont(c_acctbal, 0.25) q1, quantile_cont(c_acctbal, 0.5) q2,
 quantile_cont(c_acctbal, 0.75) q3 FROM customer GROUP BY 1)
SELECT g AS c_mktsegment, round(q1, 4) AS q1, round(q2, 4) AS median, round(q3, 4) AS q3 FROM q""")
def target_analysis_box(spark, sf):
    df = table(spark, sf, "customer")
    out = charts.target_analysis(df, "c_acctbal", "c_mktsegment", profile.kinds_dict(df))
    return _rounded(out.select("c_mktsegment", "q1", "median", "q3"), ["q1", "median", "q3"], 4)


@query("target_analysis_bars", """
SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS share
FROM orders GROUP BY 1, 2""")
def target_analysis_bars(spark, sf):
    return charts.target_analysis(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus",
                                  {"o_orderpriority": "categorical", "o_orderstatus": "categorical"})


@query("target_rate_by_segment", """
WITH d AS (SELECT c_mktsegment category, (o_totalprice > 250000)::INT y FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT category, count(*) AS n, round(avg(y), 8) AS rate, round((SELECT avg(y) FROM d), 8) AS overall FROM d GROUP BY 1""")
def target_rate_by_segment(spark, sf):
    df = (table(spark, sf, "orders").join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey"))
          .withColumn("dear", P.if_else(P.predicate("o_totalprice", ">", "250000"), "yes", "no")))
    return _rounded(charts.target_rate(df, "c_mktsegment", "dear"), ["rate", "overall"], 8)


@query("target_rate_numeric_top15", """
WITH d AS (SELECT p_size::VARCHAR category, p_retailprice y FROM part),
 t AS (SELECT category FROM d GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15)
SELECT category, count(*) AS n, round(avg(y), 5) AS rate, round((SELECT avg(y) FROM d), 5) AS overall
FROM d JOIN t USING (category) GROUP BY 1""")
def target_rate_numeric_top15(spark, sf):
    df = table(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("string"))
    return _rounded(charts.target_rate(df, "p_size", "p_retailprice", top=15), ["rate", "overall"], 5)


@query("target_rate_all_sizes", """
SELECT p_size::VARCHAR AS category, count(*) AS n, round(avg(p_retailprice), 5) AS rate, round((SELECT avg(p_retailprice) FROM part), 5) AS overall FROM part GROUP BY 1""")
def target_rate_all_sizes(spark, sf):
    """Fifty categories, none left out."""
    df = table(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("string"))
    return _rounded(charts.target_rate(df, "p_size", "p_retailprice"), ["rate", "overall"], 5)


@query("crosstab_all_types", """
SELECT p_brand, p_type, n, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY p_brand) AS share FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)""")
def crosstab_all_types(spark, sf):
    return charts.crosstab(table(spark, sf, "part"), "p_brand", "p_type", normalise=True)


@query("drift_numeric")
def drift_numeric(spark, sf):
    df = table(spark, sf, "events")
    cut = F.expr("ts < timestamp_ntz'2024-01-16 00:00:00'")
    return charts.drift_numeric(df.filter(cut), df.filter(~cut), "value")


@query("drift_categorical", """
WITH a AS (SELECT event_type v, count(*) * 1.0::DOUBLE / (SELECT count(*) FROM events WHERE ts < '2024-01-16' AND event_type <> 'view') s
  FROM events WHERE ts < '2024-01-16' AND event_type <> 'view' GROUP BY 1),
 b AS (SELECT event_type v, count(*) * 1.0::DOUBLE / (SELECT count(*) FROM events WHERE ts >= '2024-01-16' AND event_type <> 'click') s
  FROM events WHERE ts >= '2024-01-16' AND event_type <> 'click' GROUP BY 1)
SELECT coalesce(a.v, b.v) AS value, coalesce(a.s, 0) AS share_a, coalesce(b.s, 0) AS share_b FROM a FULL JOIN b ON a.v = b.v""")
def drift_categorical(spark, sf):
    df = table(spark, sf, "events")
    cut = F.expr("ts < timestamp_ntz'2024-01-16 00:00:00'")
    return charts.drift_categorical(df.filter(cut & (F.col("event_type") != "view")),
                                    df.filter(~cut & (F.col("event_type") != "click")), "event_type")


@query("class_balance", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count(*) AS classes, max(n) * 1.0::DOUBLE / sum(n) AS largest_share,
 CASE WHEN max(n) / sum(n) > 0.9 THEN 'severe' WHEN max(n) / sum(n) > 0.75 THEN 'moderate' ELSE 'ok' END AS verdict
 FROM (SELECT {c}, count(*) n FROM labels GROUP BY 1) HAVING count(*) <= 20""" for c in ("quality", "toxic")))
def class_balance(spark, sf):
    return profile.class_balance(table(spark, sf, "labels"))


@query("dataset_summary", """
SELECT 'orders' AS dataset, count(*) AS rows, 6 AS columns, 'o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate' AS first_columns FROM orders
UNION ALL SELECT 'nation', count(*), 3, 'n_nationkey, n_name, n_regionkey' FROM nation""")
def dataset_summary(spark, sf):
    return profile.dataset_summary({n: table(spark, sf, n) for n in ("orders", "nation")})
