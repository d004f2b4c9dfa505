from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import binning as B, encode as E, scale as S, text_features as T
from workload.registry import query, table, wide_table


def _r(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("scale_standard_minmax", """
WITH s AS (SELECT avg(p_size) m, stddev_pop(p_size) sd, min(p_retailprice) lo, max(p_retailprice) hi FROM part)
SELECT p_partkey, round((p_size - m) / sd, 6) AS z, round((p_retailprice - lo) / (hi - lo), 6) AS u FROM part, s""")
def scale_standard_minmax(spark, sf):
    df = table(spark, sf, "part")
    z, u = S.fit_moments(df, ["p_size"]), S.fit_min_max(df, ["p_retailprice"])
    return df.select("p_partkey", F.round(S.standard_expr("p_size", z), 6).alias("z"),
                     F.round(S.min_max_expr("p_retailprice", u), 6).alias("u"))


@query("scale_robust_maxabs", """
WITH s AS (SELECT quantile_cont(c_acctbal, 0.25) a, quantile_cont(c_acctbal, 0.5) b, quantile_cont(c_acctbal, 0.75) c,
 max(abs(c_acctbal)) m FROM customer)
SELECT c_custkey, round((c_acctbal - b) / (c - a), 6) AS rob, round(c_acctbal / m, 6) AS ma FROM customer, s""")
def scale_robust_maxabs(spark, sf):
    df = table(spark, sf, "customer")
    rob, ma = S.fit_robust(df, ["c_acctbal"]), S.fit_max_abs(df, ["c_acctbal"])
    return df.select("c_custkey", F.round(S.robust_expr("c_acctbal", rob), 6).alias("rob"),
                     F.round(S.max_abs_expr("c_acctbal", ma), 6).alias("ma"))


@query("scale_power")
def scale_power(spark, sf):
    df = table(spark, sf, "lineitem")
    yj = S.fit_power(df, ["l_extendedprice"])
    bc = S.fit_power(df, ["l_extendedprice"], "box-cox")
    out = df.select(S.power_expr("l_extendedprice", yj).alias("yj"), S.power_expr("l_extendedprice", bc, "box-cox").alias("bc"))
    return out.agg(F.round(F.avg("yj"), 4).alias("mean_yj"), F.round(F.stddev_pop("yj"), 4).alias("sd_yj"),
                   F.round(F.avg("bc"), 4).alias("mean_bc"), F.round(F.stddev_pop("bc"), 4).alias("sd_bc"))


@query("scale_quantile")
def scale_quantile(spark, sf):
    df = table(spark, sf, "orders")
    p = S.fit_quantile(df, ["o_totalprice"])
    return df.select("o_orderkey", F.round(S.quantile_expr("o_totalprice", p), 6).alias("uniform"),
                     F.round(S.quantile_expr("o_totalprice", p, "normal"), 5).alias("normal"))


@query("scale_expressions", """
SELECT c_custkey, CASE WHEN c_acctbal > -1 THEN round(ln(1 + c_acctbal), 8) END AS lg, sqrt(greatest(c_acctbal, 0)) AS root,
 (c_acctbal > 0)::INT AS positive FROM customer""")
def scale_expressions(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.round(S.log1p_expr("c_acctbal"), 8).alias("lg"),
                                               S.sqrt_expr("c_acctbal").alias("root"),
                                               S.binarise_expr("c_acctbal").alias("positive"))


@query("scale_rows", """
SELECT p_partkey, round(p_size / sqrt(p_size * p_size + p_retailprice * p_retailprice), 8) AS p_size_l2,
 round(p_retailprice / sqrt(p_size * p_size + p_retailprice * p_retailprice), 8) AS p_retailprice_l2,
 round(p_size / (abs(p_size) + abs(p_retailprice)), 8) AS p_size_l1,
 round(p_retailprice / (abs(p_size) + abs(p_retailprice)), 8) AS p_retailprice_l1 FROM part""")
def scale_rows(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    out = S.normalise_rows(S.normalise_rows(df, ["p_size", "p_retailprice"], "l2", "_l2"), ["p_size", "p_retailprice"], "l1", "_l1")
    names = ["p_size_l2", "p_retailprice_l2", "p_size_l1", "p_retailprice_l1"]
    return _r(out.select("p_partkey", *names), 8, *names)


@query("polynomial_features", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax, l_quantity * l_quantity AS "l_quantity^2", l_quantity * l_tax AS "l_quantity l_tax",
 l_tax * l_tax AS "l_tax^2" FROM lineitem""")
def polynomial_features(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    return S.polynomial(df, ["l_quantity", "l_tax"])


@query("enc_count_frequency", """
WITH c AS (SELECT p_brand, count(*) n FROM part GROUP BY 1)
SELECT p_partkey, n AS brand_count, n * 1.0::DOUBLE / (SELECT count(p_brand) FROM part) AS brand_share FROM part JOIN c USING (p_brand)""")
def enc_count_frequency(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_brand")
    lk = E.fit_counts(df, "p_brand")
    return E.apply_frequency(E.apply_counts(df, "p_brand", lk, "brand_count"), "p_brand", lk, "brand_share").drop("p_brand")


@query("enc_one_hot", "SELECT o_orderkey, " + ", ".join(
    f"(coalesce(o_orderstatus, '') = '{v}')::INT AS \"o_orderstatus_{v}\"" for v in "FOP")
       + " FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders)")
def enc_one_hot(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.expr("if(o_orderkey % 9 = 0, null, o_orderstatus) as o_orderstatus"))
    return E.one_hot(df, "o_orderstatus", E.fit_categories(df, "o_orderstatus"))


@query("enc_one_hot_fitted", "SELECT o_orderkey, " + ", ".join(
    f"(o_orderpriority = '{v}')::INT AS \"o_orderpriority_{v}\"" for v in ("1-URGENT", "2-HIGH"))
       + " FROM orders")
def enc_one_hot_fitted(spark, sf):
    """Fitted on two priorities, applied to all: unknown categories give zeros."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return E.one_hot(df, "o_orderpriority", E.fit_categories(df.filter("o_orderpriority < '3'"), "o_orderpriority"))


@query("enc_label_ordinal", """
WITH k AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)),
 o AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_size > 40 AND p_brand > 'Brand#2'))
SELECT p_partkey, k.code AS label, coalesce(o.code, -1) AS ordinal FROM part LEFT JOIN k USING (p_brand) LEFT JOIN o USING (p_brand)""")
def enc_label_ordinal(spark, sf):
    df = table(spark, sf, "part")
    seen = df.filter("p_size > 40 and p_brand > 'Brand#2'")
    out = E.apply_labels(df.select("p_partkey", "p_brand"), "p_brand", E.fit_labels(df, "p_brand"), "label")
    return E.apply_labels(out, "p_brand", E.fit_labels(seen, "p_brand"), "ordinal", unknown=-1).drop("p_brand")


@query("enc_target", """
WITH p AS (SELECT avg(p_retailprice) prior FROM part), c AS (SELECT p_brand, count(*) n, avg(p_retailprice) m, sum(p_retailprice) s FROM part GROUP BY 1)
SELECT p_partkey, round(prior * (1 - 1 / (1 + exp(-(n - 20.0)))) + m * (1 / (1 + exp(-(n - 20.0)))), 5) AS smoothed,
 round((s + prior) / (n + 1), 5) AS m_estimate FROM part JOIN c USING (p_brand), p""")
def enc_target(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    out = E.apply_target(df, "p_brand", E.fit_target(df, "p_brand", "p_retailprice"), "smoothed")
    out = E.apply_target(out, "p_brand", E.fit_target(df, "p_brand", "p_retailprice", method="m"), "m_estimate")
    return _r(out.select("p_partkey", "smoothed", "m_estimate"), 5, "smoothed", "m_estimate")


@query("enc_leave_one_out", """
WITH c AS (SELECT p_brand, p_size, count(*) n, sum(p_retailprice) s FROM part GROUP BY 1, 2)
SELECT p_partkey, round(CASE WHEN n > 1 THEN (s - p_retailprice) / (n - 1) ELSE (SELECT avg(p_retailprice) FROM part) END, 5) AS loo
FROM part JOIN c USING (p_brand, p_size)""")
def enc_leave_one_out(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_size").alias("kind"), "p_retailprice")
    return _r(E.leave_one_out(df, "kind", "p_retailprice", "loo").select("p_partkey", "loo"), 5, "loo")


@query("enc_base_n", """
WITH k AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) AS i FROM (SELECT DISTINCT o_orderpriority FROM orders))
SELECT o_orderkey, ((i // 4) % 2)::INT AS "o_orderpriority_0", ((i // 2) % 2)::INT AS "o_orderpriority_1", (i % 2)::INT AS "o_orderpriority_2"
FROM orders JOIN k USING (o_orderpriority)""")
def enc_base_n(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return E.base_n(df, "o_orderpriority", E.fit_labels(df, "o_orderpriority"), 2).drop("o_orderpriority")


@query("enc_hashing", "SELECT p_partkey, " + ", ".join(
    f"(('0x' || substr(md5(p_name), 1, 8))::BIGINT % 8 = {i})::INT AS p_name_{i}" for i in range(8)) + " FROM part")
def enc_hashing(spark, sf):
    return E.hashing(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name").drop("p_name")


@query("enc_bool_map", """
SELECT o_orderkey, (s IN ('yes', 'True'))::INT AS urgent FROM (SELECT o_orderkey,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'yes' WHEN '2-HIGH' THEN 'True' WHEN '3-MEDIUM' THEN 'YES' ELSE 'no' END AS s FROM orders)""")
def enc_bool_map(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.expr(
        "case o_orderpriority when '1-URGENT' then 'yes' when '2-HIGH' then 'True' when '3-MEDIUM' then 'YES' else 'no' end as s"))
    return E.bool_map(df, "s", "urgent").drop("s")


@query("enc_dates", """
SELECT event_id, year(ts)::INT AS a_year, month(ts)::INT AS a_month, day(ts)::INT AS a_day, year(ts)::INT AS b_year, month(ts)::INT AS b_month,
 day(ts)::INT AS b_day, (isodow(ts) - 1)::INT AS b_dow, hour(ts)::INT AS b_hour, (isodow(ts) >= 6)::INT AS b_is_weekend,
 floor(epoch(ts))::BIGINT AS c, round(sin(2 * pi() * month(ts) / 12), 8) AS d_month_sin, round(cos(2 * pi() * month(ts) / 12), 8) AS d_month_cos FROM events""")
def enc_dates(spark, sf):
    df = table(spark, sf, "events").select("event_id", *[F.col("ts").alias(c) for c in "abcd"])
    return _r(E.date_cycle(E.date_epoch(E.date_full(E.date_basic(df, "a"), "b"), "c"), "d"), 8, "d_month_sin", "d_month_cos")


@query("enc_default_plan", """
WITH s AS (SELECT avg(c_nationkey) m, stddev_pop(c_nationkey) sd FROM customer)
SELECT round((c_nationkey - m) / sd, 6) AS c_nationkey, """ + ", ".join(
    f"(c_mktsegment = '{v}')::INT AS \"c_mktsegment_{v}\"" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
       + " FROM customer, s")
def enc_default_plan(spark, sf):
    from millrace.operators.profile import kinds_dict
    df = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return _r(E.apply_plan(df, E.default_plan(kinds_dict(df))), 6, "c_nationkey")


@query("bin_width", """
WITH s AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders)
SELECT o_orderkey, """ + " + ".join(f"(o_totalprice > lo + {i} * (hi - lo) / 5)::INT" for i in range(1, 5)) + " AS bin FROM orders, s")
def bin_width(spark, sf):
    df = table(spark, sf, "orders")
    return df.select("o_orderkey", B.bin_code("o_totalprice", B.width_edges(df, "o_totalprice", 5)).alias("bin"))


@query("bin_frequency", """
WITH s AS (SELECT """ + ", ".join(f"quantile_cont(o_totalprice, {i / 4}) q{i}" for i in range(1, 4)) + """ FROM orders)
SELECT o_orderkey, (o_totalprice > q1)::INT + (o_totalprice > q2)::INT + (o_totalprice > q3)::INT AS bin FROM orders, s""")
def bin_frequency(spark, sf):
    df = table(spark, sf, "orders")
    return df.select("o_orderkey", B.bin_code("o_totalprice", B.frequency_edges(df, "o_totalprice", 4)).alias("bin"))


@query("bin_custom", """
SELECT p_partkey, CASE WHEN p_size > 5 AND p_size <= 10 THEN '(5, 10]' WHEN p_size > 10 AND p_size <= 30 THEN '(10, 30]'
 WHEN p_size > 30 AND p_size <= 45 THEN '(30, 45]' END AS bin FROM part""")
def bin_custom(spark, sf):
    return table(spark, sf, "part").select("p_partkey", B.bin_label("p_size", [5, 10, 30, 45], include_lowest=False).alias("bin"))


_W2 = "[\\p{L}\\p{M}\\p{N}_]{2,}"


def _tf_sql(size: int, ngrams: int = 1) -> str:
    toks = f"SELECT doc_id, regexp_extract_all(lower(text), '{_W2}') AS w FROM documents"
    uni = "SELECT doc_id, unnest(w) AS term FROM t0"
    if ngrams == 2:
        uni += (" UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t0")
    return f"""WITH t0 AS ({toks}), t AS ({uni}),
 v AS (SELECT term FROM t GROUP BY 1 ORDER BY count(*) DESC, term LIMIT {size}),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM t JOIN v USING (term) GROUP BY 1, 2)"""


def _tfidf_sql(size: int, ngrams: int = 1) -> str:
    return _tf_sql(size, ngrams) + """,
 idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
 x AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 7) AS weight FROM x"""


@query("bow_counts", _tf_sql(100) + " SELECT doc_id, term, tf FROM tf")
def bow_counts(spark, sf):
    return T.bag_of_words(wide_table(spark, sf, "documents"), "doc_id", "text")


@query("tfidf_unigram", _tfidf_sql(50))
def tfidf_unigram(spark, sf):
    return _r(T.tfidf(wide_table(spark, sf, "documents"), "doc_id", "text", 50), 7, "weight")


@query("tfidf_bigram", _tfidf_sql(100, 2))
def tfidf_bigram(spark, sf):
    return _r(T.tfidf(wide_table(spark, sf, "documents"), "doc_id", "text", 100, 2), 7, "weight")


@query("hashing_vector", f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_W2}')) AS term FROM documents),
 b AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS bucket, count(*)::DOUBLE AS w FROM t GROUP BY 1, 2)
SELECT doc_id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 7) AS weight FROM b""")
def hashing_vector(spark, sf):
    return _r(T.hashing_vector(wide_table(spark, sf, "documents"), "doc_id", "text"), 7, "weight")
