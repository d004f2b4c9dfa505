from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import dates, numeric, predicates as P, text
from millrace.operators import columns as C, scale
from workload.registry import query, table, wide_table


@query("table_preview", """
SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'
ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def table_preview(spark, sf):
    return C.preview(table(spark, sf, "orders"), "o_orderstatus = 'F'",
                     [F.desc("o_totalprice"), F.asc("o_orderkey")],
                     ["o_orderkey", "o_totalprice", "o_orderstatus"], 25)


@query("new_columns", "SELECT c_acctbal * 2 AS doubled, upper(c_mktsegment) AS segment FROM customer")
def new_columns(spark, sf):
    df = table(spark, sf, "customer")
    return C.new_columns(C.formulas(df, {"doubled": "c_acctbal * 2", "segment": "upper(c_mktsegment)"}),
                         df.columns)


_NULLED = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END"


def _events_with_gaps(spark, sf):
    return table(spark, sf, "events").withColumn("value", F.expr(_NULLED))


@query("predicates_compare", f"""
SELECT event_id, coalesce(v = 50, false) AS eq, (v IS DISTINCT FROM 50) AS ne, coalesce(v > 50, false) AS gt,
 coalesce(v >= 50, false) AS ge, coalesce(v < 50, false) AS lt, coalesce(v <= 50, false) AS le
FROM (SELECT event_id, {_NULLED} AS v FROM events)""")
def predicates_compare(spark, sf):
    ops = {"eq": "==", "ne": "!=", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}
    return _events_with_gaps(spark, sf).select(
        "event_id", *[P.predicate("value", op, "50").alias(n) for n, op in ops.items()])


@query("predicates_membership", f"""
SELECT event_id, coalesce(event_type IN ('click','view'), false) AS member,
 coalesce(event_type NOT IN ('click','view'), true) AS not_member, v IS NULL AS missing, v IS NOT NULL AS present
FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS event_type,
 {_NULLED} AS v FROM events)""")
def predicates_membership(spark, sf):
    df = _events_with_gaps(spark, sf).withColumn("event_type", F.expr("if(event_id % 5 = 0, null, event_type)"))
    return df.select("event_id", P.predicate("event_type", "isin", "click, view").alias("member"),
                     P.predicate("event_type", "not isin", "click, view").alias("not_member"),
                     P.predicate("value", "is null").alias("missing"),
                     P.predicate("value", "is not null").alias("present"))


@query("predicates_text", """
SELECT p_partkey, regexp_matches(p_name, 'r[ei]') AS has, starts_with(p_name, 'red') AS starts,
 ends_with(p_name, 'ring') AS ends FROM part""")
def predicates_text(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", P.predicate("p_name", "contains", "r[ei]").alias("has"),
        P.predicate("p_name", "startswith", "red").alias("starts"),
        P.predicate("p_name", "endswith", "ring").alias("ends"))


@query("condition_columns", """
SELECT o_orderkey, CASE WHEN o_totalprice > 100000 AND o_orderstatus = 'F' THEN 'big' ELSE o_orderpriority END AS tier,
 CASE WHEN o_totalprice > 400000 OR o_orderstatus = 'P' THEN 1 ELSE 0 END AS flag FROM orders""")
def condition_columns(spark, sf):
    df = table(spark, sf, "orders")
    big, done = P.predicate("o_totalprice", ">", "100000"), P.predicate("o_orderstatus", "==", "F")
    either = P.combine([P.predicate("o_totalprice", ">", "400000"), P.predicate("o_orderstatus", "==", "P")], "OR")
    return df.select("o_orderkey", P.if_else(P.combine([big, done]), "big", F.col("o_orderpriority")).alias("tier"),
                     P.if_else(either, 1, 0).alias("flag"))


@query("value_map", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS state FROM orders""")
def value_map(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", P.map_values("o_orderstatus", P.parse_map("F:done, O:open")).alias("state"))


@query("user_formula", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS net,
 CASE WHEN l_tax = 0 THEN 'free' ELSE 'taxed' END AS tax_kind, year(l_shipdate) AS ship_year FROM lineitem""")
def user_formula(spark, sf):
    df = C.formulas(table(spark, sf, "lineitem"), {
        "net": "l_extendedprice * (1 - l_discount)", "tax_kind": "if(l_tax = 0, 'free', 'taxed')",
        "ship_year": "cast(year(l_shipdate) as bigint)"})
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "net", "tax_kind", "ship_year")


@query("formula_snippets", """
WITH s AS (SELECT avg(p_retailprice) m, stddev_samp(p_retailprice) sd, min(p_size) lo, max(p_size) hi FROM part),
 c AS (SELECT p_brand, count(*) n FROM part GROUP BY 1)
SELECT p_partkey, CAST(p_size <> 1 AS INT) AS flag, p_retailprice / nullif(p_size - 1, 0) AS ratio,
 round((p_retailprice - m) / sd, 6) AS z, (p_size - lo) / (hi - lo) AS unit, ln(1 + p_retailprice) AS lg,
 p_size * p_retailprice AS product, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size_class,
 n AS brand_count FROM part JOIN c USING (p_brand), s""")
def formula_snippets(spark, sf):
    from millrace.operators import encode
    df = table(spark, sf, "part")
    mean_sd = scale.fit_moments(df, ["p_retailprice"], ddof=1)
    unit = scale.fit_min_max(df, ["p_size"])
    out = df.select(
        "p_partkey", "p_brand", numeric.flag_not("p_size", 1).alias("flag"),
        F.try_divide(F.col("p_retailprice"), F.col("p_size") - 1).alias("ratio"),
        F.round(scale.standard_expr("p_retailprice", mean_sd), 6).alias("z"),
        scale.min_max_expr("p_size", unit).alias("unit"), numeric.unary("p_retailprice", "log").alias("lg"),
        numeric.binary("p_size", "*", "p_retailprice").alias("product"),
        P.if_else(P.predicate("p_size", ">", "25"), "large", "small").alias("size_class"))
    counts = encode.fit_counts(df, "p_brand")
    return encode.apply_counts(out, "p_brand", counts, "brand_count").drop("p_brand")


@query("column_edits", """
SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_mktsegment AS segment_copy FROM customer""")
def column_edits(spark, sf):
    df = C.drop_columns(table(spark, sf, "customer"), ["c_acctbal"])
    return C.set_kind(C.duplicate_column(df, "c_mktsegment", "segment_copy"), "c_custkey", "id_like")


@query("same_operation_on_all", """
SELECT 'orders' AS dataset, round(sum(sqrt(o_totalprice)), 2) AS total FROM orders
UNION ALL SELECT 'lineitem', round(sum(sqrt(l_extendedprice)), 2) FROM lineitem""")
def same_operation_on_all(spark, sf):
    frames = {"orders": table(spark, sf, "orders").select(F.col("o_totalprice").alias("price")),
              "lineitem": table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("price"))}
    done = C.on_each(frames, lambda d: d.withColumn("root", numeric.unary("price", "sqrt")))
    parts = [d.agg(F.round(F.sum("root"), 2).alias("total")).select(F.lit(n).alias("dataset"), "total")
             for n, d in done.items()]
    return parts[0].unionByName(parts[1])


@query("math_binary", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + l_tax AS plus, l_quantity - l_discount AS minus,
 l_quantity * l_extendedprice AS times, l_quantity / nullif(l_tax, 0) AS per,
 (l_linenumber - 4) - 3 * floor((l_linenumber - 4) / 3.0) AS modulo, NULL::DOUBLE AS text_sum FROM lineitem""")
def math_binary(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("shifted", F.col("l_linenumber") - 4)
    b = numeric.binary
    return df.select("l_orderkey", "l_linenumber", "l_partkey", b("l_quantity", "+", "l_tax").alias("plus"),
                     b("l_quantity", "-", "l_discount").alias("minus"),
                     b("l_quantity", "*", "l_extendedprice").alias("times"),
                     b("l_quantity", "/", "l_tax").alias("per"), b("shifted", "Modulo", 3).alias("modulo"),
                     b("l_returnflag", "+", 1).alias("text_sum"))


@query("math_unary", """
SELECT c_custkey, CASE WHEN c_acctbal > -1 THEN round(ln(1 + c_acctbal), 8) END AS lg, exp(c_acctbal / 10000) AS ex,
 sqrt(greatest(c_acctbal, 0)) AS root, c_acctbal * c_acctbal AS sq, abs(c_acctbal) AS ab FROM customer""")
def math_unary(spark, sf):
    df = table(spark, sf, "customer").withColumn("small", F.col("c_acctbal") / 10000)
    u = numeric.unary
    return df.select("c_custkey", F.round(u("c_acctbal", "log"), 8).alias("lg"), u("small", "exp").alias("ex"),
                     u("c_acctbal", "sqrt").alias("root"), u("c_acctbal", "square").alias("sq"),
                     u("c_acctbal", "abs").alias("ab"))


@query("math_power", "SELECT p_partkey, pow(p_size, 2) / p_retailprice AS ratio FROM part")
def math_power(spark, sf):
    return table(spark, sf, "part").select("p_partkey", numeric.power_ratio("p_size", 2, "p_retailprice").alias("ratio"))


@query("text_case_length", """
SELECT doc_id, md5(lower(text)) AS low, md5(upper(lang)) AS up, length(text) AS len FROM documents""")
def text_case_length(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(text.case_or_length("text", "Lowercase")).alias("low"),
        F.md5(text.case_or_length("lang", "Uppercase")).alias("up"),
        text.case_or_length("text", "Length").cast("long").alias("len"))


@query("text_extract", """
SELECT page_id, CASE WHEN regexp_matches(url, '[a-z]+\\.example') THEN regexp_extract(url, '[a-z]+\\.example') END AS host,
 CASE WHEN regexp_matches(url, 'page=[0-9]+') THEN regexp_extract(url, 'page=[0-9]+') END AS page FROM pages""")
def text_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.extract("url", r"[a-z]+\.example").alias("host"),
                                            text.extract("url", "page=[0-9]+").alias("page"))


@query("text_replace", "SELECT page_id, regexp_replace(url, '[0-9]+', 'N', 'g') AS shape FROM pages")
def text_replace(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.replace("url", "[0-9]+", "N").alias("shape"))


@query("text_split_keep", """
SELECT page_id, string_split(url, '.')[2] AS second, string_split(url, '.')[9] AS ninth FROM pages""")
def text_split_keep(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.split_keep("url", ".", 1).alias("second"),
                                            text.split_keep("url", ".", 8).alias("ninth"))


_SPACE = "[ \\t\\n\\r\\f\\v]"


@query("text_clean", f"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text),
 '^{_SPACE}+|{_SPACE}+$', '', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_ \\t\\n\\r\\f\\v]', '', 'g'), '[0-9]+', '', 'g'),
 '{_SPACE}+', ' ', 'g')) AS cleaned FROM documents""")
def text_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.clean("text", digits=True)).alias("cleaned"))


@query("date_parts", """
SELECT o_orderkey, year(o_orderdate)::INT AS "o_orderdate_Year", month(o_orderdate)::INT AS "o_orderdate_Month",
 day(o_orderdate)::INT AS "o_orderdate_Day", (isodow(o_orderdate) - 1)::INT AS "o_orderdate_DayOfWeek",
 hour(o_orderdate)::INT AS "o_orderdate_Hour", minute(o_orderdate)::INT AS "o_orderdate_Minute",
 (isodow(o_orderdate) >= 6)::INT AS "o_orderdate_IsWeekend" FROM orders""")
def date_parts(spark, sf):
    return dates.add_parts(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query("casts", """
SELECT event_id, CASE WHEN value = floor(value) THEN value::BIGINT END AS as_int, event_id::DOUBLE AS as_float,
 user_id::VARCHAR AS as_text, TRY_CAST(substr(ts::VARCHAR, 1, 19) AS TIMESTAMP) AS as_time, event_type AS as_category,
 value <> 0 AS as_bool, length(event_type) > 0 AS text_bool FROM events""")
def casts(spark, sf):
    df = table(spark, sf, "events").withColumn("ts_text", F.substring(F.col("ts").cast("string"), 1, 19))
    c = dates.cast_to
    return df.select("event_id", c(df, "value", "int").alias("as_int"), c(df, "event_id", "float").alias("as_float"),
                     c(df, "user_id", "string").alias("as_text"), c(df, "ts_text", "datetime").alias("as_time"),
                     c(df, "event_type", "category").alias("as_category"), c(df, "value", "bool").alias("as_bool"),
                     c(df, "event_type", "bool").alias("text_bool"))


@query("top_words", """
SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')) AS word
 FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 15""")
def top_words(spark, sf):
    return (wide_table(spark, sf, "documents").select(F.explode(text.words("text")).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(15))


@query("json_property", """
SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total_k, count(*) AS n
FROM events GROUP BY 1""")
def json_property(spark, sf):
    parsed = F.from_json("props", "k BIGINT")
    return (table(spark, sf, "events").withColumn("k", parsed["k"]).groupBy("event_type")
            .agg(F.sum("k").alias("total_k"), F.count(F.lit(1)).alias("n")))
