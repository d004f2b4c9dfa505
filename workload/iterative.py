from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import iterative as I
from workload.registry import query, table


@query("impute_chained", """
WITH d AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity q, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_extendedprice END p FROM lineitem),
 r AS (SELECT regr_slope(p, q) b, regr_intercept(p, q) a FROM d)
SELECT l_orderkey, l_partkey, l_linenumber, round(coalesce(p, a + b * q), 4) AS p FROM d, r""")
def impute_chained(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_quantity").alias("q"),
                                             F.expr("if(l_orderkey % 5 = 0, null, l_extendedprice) as p"))
    return I.chained_impute(df, ["q", "p"], rounds=2).select("l_orderkey", "l_partkey", "l_linenumber", F.round("p", 4).alias("p"))


@query("outlier_isolation_forest")
def outlier_isolation_forest(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return I.isolation_forest(df, ["p_size", "p_retailprice"], "p_partkey")


@query("cluster_dbscan", """
WITH RECURSIVE s AS (SELECT s_suppkey k, s_acctbal / 1000 a, s_nationkey b FROM supplier),
 n AS (SELECT x.k, y.k o FROM s x JOIN s y ON pow(x.a - y.a, 2) + pow(x.b - y.b, 2) <= 1.0),
 c AS (SELECT k FROM n GROUP BY 1 HAVING count(*) >= 4),
 e AS (SELECT n.k, n.o FROM n WHERE k IN (SELECT k FROM c) AND o IN (SELECT k FROM c)),
 r AS (SELECT k, k AS o FROM c UNION SELECT r.k, e.o FROM r JOIN e ON r.o = e.k),
 l AS (SELECT k, min(o) AS head FROM r GROUP BY 1),
 d AS (SELECT k, dense_rank() OVER (ORDER BY head) - 1 AS cluster FROM l)
SELECT s.k AS s_suppkey, coalesce(d.cluster, (SELECT min(d2.cluster) FROM n JOIN d d2 ON d2.k = n.o WHERE n.k = s.k), -1) AS cluster, d.k IS NOT NULL AS core FROM s LEFT JOIN d ON d.k = s.k""")
def cluster_dbscan(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", F.expr("s_acctbal / 1000 as a"), F.col("s_nationkey").cast("double").alias("b"))
    return I.dbscan(df, ["a", "b"], "s_suppkey", eps=1.0, min_points=4)


@query("cluster_dbscan_wide", """
WITH RECURSIVE s AS (SELECT vec_id AS k, embedding[1:8]::DOUBLE[] AS v FROM embeddings),
 n AS (SELECT x.k, y.k o FROM s x JOIN s y ON list_sum(list_transform(list_zip(x.v, y.v), lambda p: pow(p[1] - p[2], 2))) <= 0.24::DOUBLE * 0.24::DOUBLE),
 c AS (SELECT k FROM n GROUP BY 1 HAVING count(*) >= 4),
 e AS (SELECT n.k, n.o FROM n WHERE k IN (SELECT k FROM c) AND o IN (SELECT k FROM c)),
 r AS (SELECT k, k AS o FROM c UNION SELECT r.k, e.o FROM r JOIN e ON r.o = e.k),
 l AS (SELECT k, min(o) AS head FROM r GROUP BY 1),
 d AS (SELECT k, dense_rank() OVER (ORDER BY head) - 1 AS cluster FROM l)
SELECT s.k AS vec_id, coalesce(d.cluster, (SELECT min(d2.cluster) FROM n JOIN d d2 ON d2.k = n.o WHERE n.k = s.k), -1) AS cluster, d.k IS NOT NULL AS core FROM s LEFT JOIN d ON d.k = s.k""")
def cluster_dbscan_wide(spark, sf):
    """Density clusters over eight columns: the first eight components of the embeddings."""
    df = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 8).cast("array<double>").alias("v"))
    return I.dbscan(df, "v", "vec_id", eps=0.24, min_points=4)


def _trade(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey")).select(
        F.expr("'n' || c_nationkey as src"), F.expr("'s' || c_mktsegment as dst"))


@query("graph_random_walks")
def graph_random_walks(spark, sf):
    return I.random_walks(_trade(spark, sf), length=6, walks=2)


@query("graph_node_embeddings")
def graph_node_embeddings(spark, sf):
    return I.node_embeddings(_trade(spark, sf), dimensions=8, length=5, walks=2).select("id", F.size("embedding").alias("size"))


@query("link_names_jaccard", """
WITH a AS (SELECT DISTINCT p_name l FROM part), b AS (SELECT DISTINCT p_name || ' ' || lower(p_type) r FROM part),
 sa AS (SELECT l, list_distinct(list_transform(range(1, greatest(length(l) - 2, 1) + 1), lambda i: substr(l, i::BIGINT, 3))) s FROM a),
 sb AS (SELECT r, list_distinct(list_transform(range(1, greatest(length(r) - 2, 1) + 1), lambda i: substr(r, i::BIGINT, 3))) s FROM b),
 p AS (SELECT l, r, len(list_intersect(sa.s, sb.s))::DOUBLE i, len(sa.s) x, len(sb.s) y FROM sa, sb)
SELECT l AS name, r AS full_name, round(i / (x + y - i), 8) AS jaccard FROM p WHERE i / (x + y - i) >= 0.5""")
def link_names_jaccard(spark, sf):
    part = table(spark, sf, "part")
    full = part.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("full_name"))
    out = I.jaccard_links(part.select(F.col("p_name").alias("name")), full, "name", "full_name")
    return out.withColumn("jaccard", F.round("jaccard", 8))
