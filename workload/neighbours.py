from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import neighbours as N
from millrace.plans.neighbours import nearest
from workload.registry import query, table


def _dist(n: int, a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"pow({a}[{i}]::DOUBLE - {b}[{i}]::DOUBLE, 2)" for i in range(1, n + 1)) + ")"


@query("knn_embeddings", """
WITH d AS (SELECT a.vec_id, b.vec_id AS id, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: pow(x[1]::DOUBLE - x[2]::DOUBLE, 2)))) AS dist
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, id) AS i FROM d)
SELECT vec_id, i AS rank, id, round(dist, 6) AS dist FROM r WHERE i <= 5""")
def knn_embeddings(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    hits = nearest(df, df, 5, "vec_id", "vec_id", exclude_same=True)
    return hits.select("vec_id", F.posexplode("neighbours").alias("pos", "n")).select(
        "vec_id", (F.col("pos") + 1).cast("long").alias("rank"), "n.id", F.round("n.dist", 6).alias("dist"))


_SUP = "(SELECT s_suppkey, s_acctbal / 1000 AS a, s_nationkey AS b, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_acctbal END AS t FROM supplier)"


def _suppliers(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.expr("s_acctbal / 1000 as a"), F.col("s_nationkey").cast("double").alias("b"),
                                               F.expr("if(s_suppkey % 6 = 0, null, s_acctbal) as t"))


@query("impute_knn", f"""
WITH s AS {_SUP}, d AS (SELECT q.s_suppkey k, p.t, row_number() OVER (PARTITION BY q.s_suppkey ORDER BY sqrt(pow(q.a - p.a, 2) + pow(q.b - p.b, 2)), p.s_suppkey) i
 FROM s q JOIN s p ON q.t IS NULL AND p.t IS NOT NULL)
SELECT s.s_suppkey, round(coalesce(s.t, m.t), 6) AS t FROM s LEFT JOIN (SELECT k, avg(t) t FROM d WHERE i <= 5 GROUP BY 1) m ON m.k = s.s_suppkey""")
def impute_knn(spark, sf):
    return N.knn_impute(_suppliers(spark, sf), ["a", "b", "t"], "s_suppkey").select("s_suppkey", F.round("t", 6).alias("t"))


_HOLES = ("(SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal / 1000 END AS a, CASE WHEN c_custkey % 4 = 0 THEN NULL "
          "ELSE c_nationkey::DOUBLE END AS b, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey % 11)::DOUBLE END AS t FROM customer)")
_GAP = "coalesce(pow(q.a - p.a, 2), 0) + coalesce(pow(q.b - p.b, 2), 0) + coalesce(pow(q.t - p.t, 2), 0)"
_SHARED = "((q.a - p.a IS NOT NULL)::INT + (q.b - p.b IS NOT NULL)::INT + (q.t - p.t IS NOT NULL)::INT)"


def _taken(c: str) -> str:
    return (f"coalesce(s.{c}, (SELECT avg(x) FROM n WHERE n.k = s.k AND n.c = '{c}'), (SELECT avg({c}) FROM s))")


def _donors(c: str) -> str:
    return (f"SELECT q.k, '{c}' AS c, p.{c} AS x, row_number() OVER (PARTITION BY q.k ORDER BY sqrt(3.0::DOUBLE / {_SHARED} * ({_GAP})), p.k) AS i "
            f"FROM s q JOIN s p ON q.{c} IS NULL AND p.{c} IS NOT NULL AND {_SHARED} > 0")


@query("impute_knn_patterns", f"""
WITH s AS {_HOLES}, n AS (SELECT * FROM ({" UNION ALL ".join(map(_donors, "abt"))}) WHERE i <= 5)
SELECT s.k AS c_custkey, {", ".join(f"round({_taken(c)}, 6) AS {c}" for c in "abt")} FROM s""")
def impute_knn_patterns(spark, sf):
    """All eight patterns of holes in three columns, the row without any value included."""
    df = table(spark, sf, "customer").select("c_custkey", F.expr("if(c_custkey % 3 = 0, null, c_acctbal / 1000) as a"),
                                             F.expr("if(c_custkey % 4 = 0, null, cast(c_nationkey as double)) as b"),
                                             F.expr("if(c_custkey % 5 = 0, null, cast(c_custkey % 11 as double)) as t"))
    return N.knn_impute(df, ["a", "b", "t"], "c_custkey").select("c_custkey", *[F.round(c, 6).alias(c) for c in "abt"])


@query("outlier_lof", """
WITH c AS (SELECT c_custkey k, c_acctbal / 1000 a, c_nationkey b FROM customer),
 d AS (SELECT p.k, q.k n, sqrt(pow(p.a - q.a, 2) + pow(p.b - q.b, 2)) dist FROM c p JOIN c q ON p.k <> q.k),
 h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY dist, n) i FROM d) WHERE i <= 20),
 kd AS (SELECT k, max(dist) kd FROM h GROUP BY 1),
 l AS (SELECT h.k, 1 / (avg(greatest(h.dist, kd.kd)) + 1e-10) lrd FROM h JOIN kd ON kd.k = h.n GROUP BY 1)
SELECT h.k AS c_custkey, round(avg(b.lrd) / max(a.lrd), 6) AS lof, (avg(b.lrd) / max(a.lrd) > 1.5)::INT AS is_outlier
FROM h JOIN l a ON a.k = h.k JOIN l b ON b.k = h.n GROUP BY 1""")
def outlier_lof(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.expr("c_acctbal / 1000 as a"), F.col("c_nationkey").alias("b"))
    return N.local_outlier_factor(df, ["a", "b"], "c_custkey").withColumn("lof", F.round("lof", 6))


@query("knn_classifier", """
WITH d AS (SELECT a.vec_id, b.label, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: pow(x[1]::DOUBLE - x[2]::DOUBLE, 2)))) AS dist, b.vec_id AS id
  FROM embeddings a JOIN embeddings b ON a.vec_id % 5 = 0 AND b.vec_id % 5 > 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, id) AS i FROM d),
 v AS (SELECT vec_id, label, count(*) c FROM r WHERE i <= 5 GROUP BY 1, 2)
SELECT vec_id, arg_min(label, (-c, label)) AS prediction FROM v GROUP BY 1""")
def knn_classifier(spark, sf):
    df = table(spark, sf, "embeddings")
    return N.knn_predict(df.filter("vec_id % 5 > 0"), df.filter("vec_id % 5 = 0"), "embedding", "label", "vec_id", "vec_id")


_MIN = "(SELECT doc_id, least(n_chars, 20000) / 1000.0::DOUBLE AS a, doc_id % 17 AS b, quality AS y FROM documents JOIN labels USING (doc_id))"


def _docs(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.expr("least(n_chars, 20000) / 1000.0D as a"), F.expr("cast(doc_id % 17 as double) as b"), F.col("quality").alias("y"))


_UNIT = "('0x' || substr(md5(concat_ws('#', k, copy, {0})), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query("balance_smote", f"""
WITH t AS {_MIN}, s AS (SELECT count(*) FILTER (y = 1) - count(*) FILTER (y = 0) AS need, count(*) FILTER (y = 0) AS n FROM t),
 m AS (SELECT doc_id AS k, a, b, row_number() OVER (ORDER BY md5(concat_ws('#', doc_id, '42'))) AS i FROM t WHERE y = 0),
 c AS (SELECT k, a, b, unnest(range(1, (need // n + (i <= need % n)::INT + 1)::BIGINT)) AS copy FROM m, s),
 h AS (SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY dist, n) - 1 AS i FROM (SELECT p.k, q.k n, sqrt(pow(p.a - q.a, 2) + pow(p.b - q.b, 2)) dist FROM m p JOIN m q ON p.k <> q.k)),
 x AS (SELECT c.*, {_UNIT.format("'43'")} AS u, floor({_UNIT.format("'42'")} * 5) AS pick FROM c)
SELECT 0 AS synthetic, doc_id, NULL::BIGINT AS neighbour, round(a, 6) AS a, b::DOUBLE AS b, y FROM t
UNION ALL SELECT 1, x.k, h.n, round(x.a + x.u * (m.a - x.a), 6), round(x.b + x.u * (m.b - x.b), 6), 0 FROM x JOIN h ON h.k = x.k AND h.i = x.pick JOIN m ON m.k = h.n""")
def balance_smote(spark, sf):
    out = N.smote(_docs(spark, sf), ["a", "b"], "y", "doc_id")
    return out.withColumns({"a": F.round("a", 6), "b": F.round("b", 6)})


@query("balance_adasyn")
def balance_adasyn(spark, sf):
    return N.adasyn(_docs(spark, sf), ["a", "b"], "y", "doc_id", 0)
