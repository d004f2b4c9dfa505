"""The shared building blocks, with their large-data paths forced on small data."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from millrace.operators import clean, correlate, series
from millrace.operators.charts import sample_rows
from millrace.operators.columns import preview
from millrace.operators.graph import connected_components
from millrace.plans import counting, hashing, lookup, ordering


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one key; gaps at the start, in the middle and at the end."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        g = "hot" if i % 3 == 0 else f"g{i % 40}"
        rows.append((i, g, rng.randrange(10**6), None if rng.random() < 0.3 else round(rng.random() * 100, 3)))
    return spark.createDataFrame(rows, "id long, g string, ord long, x double").repartition(7).cache()


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_row_numbers_in_ranges(hot):
    a = ordering.row_numbers(hot, ["g"], ["ord", "id"], "rn", block_rows=20)
    b = hot.withColumn("rn", F.row_number().over(W.partitionBy("g").orderBy("ord", "id")))
    assert rows(a, "id", "rn") == rows(b, "id", "rn")


def test_cold_rows_are_not_written(hot, monkeypatch):
    """Only rows of hot keys go through the range partitioning and the checkpoint; nulls may be hot or cold."""
    written = []
    cut = ordering.cut
    monkeypatch.setattr(ordering, "cut", lambda df: written.append(cut(df)) or written[-1])
    for df in (hot, hot.withColumn("g", F.when(F.col("g") != "hot", F.col("g"))), hot.withColumn("g", F.when(F.col("g") != "g1", F.col("g")))):
        written.clear()
        got = ordering.row_numbers(df, ["g"], ["ord", "id"], "n", block_rows=100)
        want = df.withColumn("n", F.row_number().over(W.partitionBy("g").orderBy("ord", "id")).cast("long"))
        assert rows(got, "id", "n") == rows(want, "id", "n")
        assert [w.count() for w in written] == [1, 300]  # the one hot key, and its rows


def test_row_numbers_without_key_and_descending(hot):
    a = ordering.row_numbers(hot, [], ["-ord", "id"], "rn", block_rows=20)
    b = hot.withColumn("rn", F.row_number().over(W.orderBy(F.desc("ord"), "id")))
    assert rows(a, "id", "rn") == rows(b, "id", "rn")


@pytest.mark.parametrize("direction", ["forward", "backward"])
def test_fill_in_blocks(hot, direction):
    small = series.fill(hot, ["x"], ["ord", "id"], ["g"], direction, block_rows=25)
    plain = series.fill(hot, ["x"], ["ord", "id"], ["g"], direction)
    assert rows(small, "id", "x") == rows(plain, "id", "x")


def test_limited_fill_in_blocks(hot):
    small = series.fill(hot, ["x"], ["ord", "id"], ["g"], limit=2, block_rows=25)
    assert rows(small, "id", "x") == rows(series.fill(hot, ["x"], ["ord", "id"], ["g"], limit=2), "id", "x")


def test_bounded_frames_in_blocks(hot):
    r = lambda n: series.rolling_mean(hot, "x", ["ord", "id"], ["g"], [3, 7], block_rows=n).withColumns(
        {c: F.round(c, 9) for c in ("x_ma3", "x_ma7")})
    assert rows(r(20), "id", "x_ma3", "x_ma7") == rows(r(10**6), "id", "x_ma3", "x_ma7")
    l = lambda n: series.lags(hot, "x", ["ord", "id"], ["g"], block_rows=n)
    assert rows(l(20), "id", "x_lag1", "x_lag3") == rows(l(10**6), "id", "x_lag1", "x_lag3")


def test_interpolate_and_decompose_in_blocks(hot):
    i = lambda n: series.interpolate(hot, "x", ["ord", "id"], ["g"], block_rows=n).withColumn("x", F.round("x", 9))
    assert rows(i(20), "id", "x") == rows(i(10**6), "id", "x")
    s = lambda n: {r["id"]: (r["trend"], r["seasonal"]) for r in
                   series.seasonal_decompose(hot, "x", ["ord", "id"], ["g"], 4, block_rows=n).collect()}
    a, b = s(30), s(10**6)
    assert a.keys() == b.keys()
    assert all(p == q or p == pytest.approx(q) for k in a for p, q in zip(a[k], b[k]))


def test_interpolate_keeps_leading_gap(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0), (3, None), (4, 3.0), (5, None)], "i long, x double")
    assert [r["x"] for r in series.interpolate(df, "x", ["i"]).orderBy("i").collect()] == [None, 1.0, 2.0, 3.0, 3.0]


def test_quantiles_both_paths(hot):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    xs = [r["x"] for r in hot.dropna().collect()]
    for limit in (10**6, 0):
        got = counting.quantile_dict(hot, ["x", "ord"], probs, distinct_limit=limit)
        assert np.allclose(got["x"], np.quantile(xs, probs))
    by = {r["g"]: r["q"] for r in counting.quantiles(hot, ["x"], probs, by=["g"], distinct_limit=0).collect()}
    mine = [r["x"] for r in hot.filter("g = 'hot'").dropna().collect()]
    assert np.allclose(by["hot"], np.quantile(mine, probs))


def test_quantiles_ignore_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    assert counting.quantile_dict(df, ["x"], [0.5])["x"] == [2.0]


def test_kth_smallest_narrows_to_the_row(hot):
    h = {r["id"]: hashlib.md5(f"{r['id']}#42".encode()).hexdigest() for r in hot.select("id").collect()}
    order = sorted(h.values())
    for k in (0, 1, 137, 900, 1000):
        cut = hashing.kth_smallest(hot, ["id"], 42, {None: k}, bucket_rows=3)
        n = hot.filter(hashing.within_cutoff(["id"], 42, cut)).count()
        assert n == min(k, 900)
        if 0 < k <= 900:
            assert cut[None] == order[k - 1]
    per = hashing.kth_smallest(hot, ["id"], 42, {"hot": 10, "g1": 2}, "g", bucket_rows=2)
    got = hot.filter(hashing.within_cutoff(["id"], 42, per, "g")).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {"hot": 10, "g1": 2}


def test_hash_numbers_are_positions(hot):
    a = hashing.hash_numbered(hot, ["id"], 42, "i", ["g"], bucket_rows=10)
    b = hot.withColumn("i", F.row_number().over(W.partitionBy("g").orderBy(hashing.hash_order(["id"], 42))))
    assert rows(a, "id", "i") == rows(b, "id", "i")


def test_lookup_splits_hot_keys(hot):
    t = hot.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("ord").alias("m"))
    withnull = hot.withColumn("g", F.when(F.col("id") % 10 > 0, F.col("g")))
    small, large = lookup.fit_lookup(t, ["g"]), lookup.fit_lookup(t, ["g"], limit=1)
    assert small.small and not large.small
    assert rows(lookup.join_lookup(withnull, small, ["m"]), "id", "m") == rows(lookup.join_lookup(withnull, large, ["m"]), "id", "m")


def test_results_do_not_depend_on_partitions(hot):
    got = [rows(clean.drop_duplicates(hot.repartition(p), ["id"], ["g"]), "id", "g") for p in (1, 4, 17)]
    assert got[0] == got[1] == got[2]
    got = [rows(sample_rows(hot.repartition(p), ["id"], 50), "id") for p in (1, 17)]
    assert got[0] == got[1] and len(got[0]) == 50


def test_components_of_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 2000 + i) for i in range(300)] + [(5000, 5000)]
    random.Random(1).shuffle(chain)
    out = connected_components(spark.createDataFrame(chain, "src long, dst long"))
    got = {r["id"]: r["component"] for r in out.collect()}
    assert all(got[i] == 0 for i in range(201)) and got[1000] == got[2299] == 1000 and got[5000] == 5000


def test_components_large_graph_path(spark, monkeypatch):
    from millrace.operators import graph
    monkeypatch.setattr(graph, "LARGE_EDGES", 0)
    out = connected_components(spark.createDataFrame([(1, 2), (2, 3), (9, 8)], "src long, dst long"))
    assert {r["id"]: r["component"] for r in out.collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}


@pytest.mark.parametrize("large", [0, 1_000_000])
def test_components_leaves_are_folded(spark, monkeypatch, large):
    """Leaves with larger and smaller ids than their neighbour, hot neighbours, edges that stand alone; only the rest goes through the rounds."""
    from millrace.operators import graph
    monkeypatch.setattr(graph, "LARGE_EDGES", large)
    sizes, rounds = [], graph._rounds
    monkeypatch.setattr(graph, "_rounds", lambda e, n: sizes.append(e.count()) or rounds(e, n))
    edges = [(100 + i, 101 + i) for i in range(20)] + [(110, 1000 + i) for i in range(50)] + [(5, 118), (7, 300), (300, 301), (300, 299)]
    edges += [(41, 40), (500, 501), (60, 60), (70, None), (301, 300)]
    out = graph.connected_components(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(9,)], "id long")).collect()
    got = {r["id"]: r["component"] for r in out}
    want = {**{100 + i: 5 for i in range(21)}, **{1000 + i: 5 for i in range(50)}, 5: 5, 7: 7, 299: 7, 300: 7, 301: 7, 40: 40, 41: 40, 500: 500, 501: 500,
            60: 60, 70: 70, None: None, 9: 9}
    assert got == want and len(out) == len(want) and sizes == [18]


def test_kendall_brute_force(spark):
    rng = random.Random(5)
    pts = [(rng.randrange(8), rng.randrange(6)) for _ in range(80)]
    df = spark.createDataFrame(pts, "a long, b long")
    c = d = tx = ty = 0
    for i in range(80):
        for j in range(i):
            s = (pts[i][0] - pts[j][0]) * (pts[i][1] - pts[j][1])
            c, d = c + (s > 0), d + (s < 0)
            tx, ty = tx + (pts[i][0] == pts[j][0]), ty + (pts[i][1] == pts[j][1])
    n0 = 80 * 79 / 2
    assert correlate.kendall(df, ["a", "b"]).first()["r"] == pytest.approx((c - d) / ((n0 - tx) * (n0 - ty)) ** 0.5)


# plans ------------------------------------------------------------------------------------------------

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_preview_is_a_top_k(spark, sf):
    p = plan(preview(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderstatus = 'F'", [F.desc("o_totalprice")], ["o_orderkey"], 5))
    assert "TakeOrderedAndProject" in p and "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in p
    assert "o_orderpriority" not in p


def test_fitted_apply_is_a_projection(spark, sf):
    from millrace.operators import binning, scale
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    out = df.select(scale.standard_expr("l_tax", scale.fit_moments(df, ["l_tax"])), binning.bin_code("l_quantity", [0.0, 10.0, 50.0]))
    assert "Exchange" not in plan(out) and "ReadSchema: struct<l_quantity:double,l_tax:double>" in plan(out)


def test_duplicates_combine_before_the_shuffle(spark, sf):
    p = plan(clean.drop_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id"], ["text"]))
    assert p.count("Exchange hashpartitioning") == 1 and "partial_" in p and "SinglePartition" not in p


def test_apply_side_accepts_streams(spark, sf):
    from millrace.functions import predicates as P, text
    from millrace.operators import clean as C, encode, scale
    static = spark.read.parquet(f"{sf}/customer.parquet")
    stream = spark.readStream.schema(static.schema).parquet(sf)
    p = scale.fit_moments(static, ["c_acctbal"])
    out = scale.apply_scaler(stream, scale.standard_expr, p)
    out = encode.one_hot(out, "c_mktsegment", ["BUILDING"])
    out = C.clip(out, {"c_acctbal": (-1.0, 1.0)}).withColumn("t", text.clean("c_name")).filter(P.predicate("c_nationkey", ">", "3"))
    assert out.isStreaming


def test_widening_only_small_scans(spark, sf):
    from millrace.plans.parallel import widened
    one = spark.read.parquet(f"{sf}/orders.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert widened(one).rdd.getNumPartitions() == cores
    p = plan(widened(one).filter("o_orderstatus = 'F'").select("o_orderkey"))
    assert "EqualTo(o_orderstatus,F)" in p and "o_orderpriority" not in p
    many = one.repartition(cores * 2)
    assert "RoundRobinPartitioning(8)" not in plan(widened(many))


def test_workers_find_the_package_from_another_folder(tmp_path):
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import sys; sys.path.insert(0, %r)\nimport __spark_entry__ as e\nfrom pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
            "print('ROWS', e.queries()['knn_embeddings'](s, '/root/testdata/sf0.001').count())") % repo
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS" in out.stdout, out.stderr[-800:]


def test_a_cluster_without_shared_folder_is_refused():
    from types import SimpleNamespace

    from millrace.plans.lineage import checkpoint_dir
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: SimpleNamespace(get=lambda k: None), master="spark://host:7077")
    with pytest.raises(RuntimeError):
        checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: None)))


def test_few_but_wide_rows_are_not_broadcast(spark):
    table = spark.range(50).select("id", F.lit(1).alias("n"), F.array_repeat(F.lit(0.5), 100).alias("v"))
    assert lookup.fit_lookup(table, ["id"]).small and not lookup.fit_lookup(table, ["id"], most_bytes=10_000).small
