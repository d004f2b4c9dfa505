"""The end-to-end query: load, clean, derive, bin, rate, rank."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import predicates as P
from millrace.functions.dates import add_parts
from millrace.operators import binning, charts, clean
from millrace.plans.lineage import cut
from workload.registry import query, table

_D = """d AS (SELECT c_mktsegment, o_orderdate, o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS price
  FROM orders JOIN customer ON o_custkey = c_custkey),
 f AS (SELECT c_mktsegment, month(o_orderdate) AS m, o_orderstatus, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM d)) AS price FROM d),
 e AS (SELECT min(price) lo, max(price) hi FROM f),
 b AS (SELECT c_mktsegment || '/' || ((price > lo + (hi - lo) / 4)::INT + (price > lo + 2 * (hi - lo) / 4)::INT + (price > lo + 3 * (hi - lo) / 4)::INT) || '/' || m AS category,
  (o_orderstatus = 'F')::INT AS y FROM f, e)"""


@query("flagship_order_rates", f"""
WITH {_D}, t AS (SELECT category FROM b GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15)
SELECT category, count(*) AS n, round(avg(y), 8) AS rate, round((SELECT avg(y) FROM b), 8) AS overall FROM b JOIN t USING (category) GROUP BY 1""")
def flagship_order_rates(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    df = (table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderstatus", F.expr("if(o_orderkey % 13 = 0, null, o_totalprice) as price"))
          .join(customers, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey"))
    df = cut(df)  # the joined table is read by several statistics
    df = clean.clean(df, {"price": "median"})
    df = add_parts(df, "o_orderdate", ["Month"])
    df = df.withColumn("bin", binning.bin_code("price", binning.width_edges(df, "price", 4)))
    df = df.withColumn("category", F.concat_ws("/", "c_mktsegment", "bin", "o_orderdate_Month"))
    df = df.withColumn("done", P.if_else(P.predicate("o_orderstatus", "==", "F"), "yes", "no"))
    out = charts.target_rate(df, "category", "done", top=15)
    return out.withColumns({"rate": F.round("rate", 8), "overall": F.round("overall", 8)})
