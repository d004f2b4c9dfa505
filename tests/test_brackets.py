"""Quantiles by sketched brackets and distinct counts that follow a sketch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import binning, clean, profile
from millrace.plans import counting

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def wide(spark):
    """60 000 rows: a spread column, one with a third of equal values, a short one with nulls, NaN and infinities, a hot group."""
    df = spark.range(60_000).repartition(4)
    u = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return df.select(
        "id", (u * 2000 - 1000).alias("spread"), F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.round(u * 14)).alias("ties"),
        F.when(F.col("id") % 11 == 0, F.lit(None).cast("double")).when(F.col("id") % 11 == 1, F.lit(float("nan"))).when(F.col("id") % 500 == 2, F.lit(float("inf")))
         .when(F.col("id") % 500 == 3, F.lit(float("-inf"))).otherwise(-F.log(u + 0.001)).alias("odd"), F.lit(None).cast("double").alias("none"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g")).cache()


def close(a, b):
    return all(x == y or np.isclose(x, y, rtol=1e-12) for x, y in zip(a, b))


@pytest.mark.parametrize("whole_rows", [0, 500, 10**9])
@pytest.mark.parametrize("limit", [0, 10**7])
def test_columns(wide, whole_rows, limit):
    cols = ["spread", "ties", "odd", "none"]
    held = wide.select(*cols).toPandas()
    got = {r["column"]: r for r in counting.quantiles(wide, cols, PROBS, distinct_limit=limit, whole_rows=whole_rows).collect()}
    assert "none" not in got
    for c in cols[:3]:
        x = np.sort(held[c].dropna().to_numpy())
        assert got[c]["n"] == len(x)
        low, high = np.floor(np.array(PROBS) * (len(x) - 1)).astype(int), np.ceil(np.array(PROBS) * (len(x) - 1)).astype(int)
        share = np.array(PROBS) * (len(x) - 1) - low
        assert close(got[c]["q"], [a if f == 0 or a == b else a + (b - a) * f for a, b, f in zip(x[low], x[high], share)])


def test_groups(wide):
    want = {g: np.quantile(v["spread"], PROBS) for g, v in wide.select("g", "spread").toPandas().groupby("g", dropna=False)}
    for whole_rows in (100, 10**6):
        got = {r["g"]: r["q"] for r in counting.quantiles(wide, ["spread"], PROBS, by=["g"], whole_rows=whole_rows).collect()}
        assert len(got) == len(want)
        assert all(close(got[g if isinstance(g, str) else None], q) for g, q in want.items())


def test_two_scans_and_few_rows(wide, spark, tmp_path):
    """However many columns there are, the table is scanned twice, and few values leave the brackets' scan."""
    wide.select("spread", "ties", "odd").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    cols = ["spread", "ties", "odd"]
    sketched = counting.quantile_brackets(df, cols, [0.5])._jdf.queryExecution().toString()
    counts, most = counting.bracketed_counts(df, cols, [0.5])
    counted = counts._jdf.queryExecution().executedPlan().toString()
    assert sketched.split("== Physical Plan ==")[1].count("FileScan") == counted.count("FileScan") == 1
    assert counts.count() < 1500 and most <= 10_000   # 60 000 rows in three columns
    assert counts.agg(F.sum("n")).first()[0] == df.select(sum(F.count(counting.num(c)) for c in cols)).first()[0]


def test_a_missed_bracket_is_noticed(wide, monkeypatch):
    """Brackets that hold none of the ranks: all values are counted instead."""
    real = counting.quantile_brackets
    monkeypatch.setattr(counting, "quantile_brackets", lambda *a, **k: real(*a, **k).withColumns({"lo0": F.array(F.lit(2e3)), "hi0": F.array(F.lit(3e3))}))
    x = wide.select("spread").toPandas()["spread"]
    assert np.isclose(counting.quantile_dict(wide, ["spread"], [0.5], whole_rows=10)["spread"][0], np.quantile(x, 0.5))


def test_many_probabilities(wide):
    probs = [i / 100 for i in range(101)]
    assert np.allclose(counting.quantile_dict(wide, ["spread"], probs)["spread"], np.quantile(wide.select("spread").toPandas()["spread"], probs))


def test_limits_and_edges_of_several_columns(wide):
    found = clean.fit_winsor(wide, ["spread", "ties", "none"])
    x = np.sort(wide.select("spread").toPandas()["spread"])
    assert found["spread"] == (x[3000], x[-3001]) and "none" not in found
    edges = binning.frequency_edges_of(wide, ["spread", "ties", "none"], 4)
    assert edges["spread"] == binning.frequency_edges(wide, "spread", 4) and "none" not in edges


def test_empty(spark):
    empty = spark.createDataFrame([], "x double, g string")
    assert counting.quantiles(empty, ["x"], [0.5]).collect() == [] == counting.quantiles(empty, ["x"], [0.5], by=["g"]).collect()


def test_kinds_by_sketch(spark):
    n = 5000
    df = spark.range(n).select(
        F.col("id").alias("key"), (F.col("id") % 2).alias("two"), F.when(F.col("id") < 4749, F.col("id")).otherwise(F.lit(0)).alias("below"),
        F.when(F.col("id") < 4751, F.col("id")).otherwise(F.lit(0)).alias("above"), (F.col("id") % 50).alias("fifty"), (F.col("id") / 7).alias("real"),
        F.concat(F.lit("a long text of more than twenty letters "), F.col("id")).alias("text"), F.concat(F.lit("k"), F.col("id")).alias("name"),
        F.lit(None).cast("string").alias("none"), F.expr("timestamp_seconds(id)").alias("at"), F.expr("date_add(date'2020-01-01', cast(id as int))").alias("day"),
        (F.col("id") % 3 == 0).alias("flag"))
    for rule in ("full", "simple"):
        meta = profile.column_metadata(df)
        exact = {r[0]: r[1] for r in meta.select("column", (profile.kind_rule(rule)).alias("k")).collect()}
        assert {r["column"]: r["kind"] for r in profile.column_kinds(df, rule).collect()} == exact
    unique = {r["column"]: r["n_unique"] for r in meta.collect()}
    assert unique == {"key": n, "two": 2, "below": 4749, "above": 4751, "fifty": 50, "real": n, "text": n, "name": n, "none": 0, "at": n, "day": n, "flag": 2}


def test_unique_columns_are_not_shuffled(spark, monkeypatch):
    seen = []
    real = profile.distinct_counts
    monkeypatch.setattr(profile, "distinct_counts", lambda df, cols: seen.extend(cols) or real(df, cols))
    df = spark.range(20_000).select("id", (F.col("id") * 3).alias("other"), (F.col("id") % 5).alias("five"), (F.col("id") % 9000).alias("half"))
    assert profile.kinds_dict(df) == {"id": "id_like", "other": "id_like", "five": "numeric", "half": "numeric"}
    assert seen == ["five"]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_a_thousand_probabilities_need_no_deep_plan(spark, limit):
    """One value holds half of the rows, a group has one row and one a null key; 1000 ranks are met as rows."""
    rows = [("a", float(i % 977) if i % 2 else 3.0) for i in range(4000)] + [("b", 7.5)] + [(None, i * 0.25) for i in range(33)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [i / 999 for i in range(1000)]
    got = {r["g"]: r for r in counting.quantiles(df, ["x"], probs, by=["g"], distinct_limit=limit).collect()}
    for g in ("a", "b", None):
        mine = [x for k, x in rows if k == g and x is not None]
        assert got[g]["n"] == len(mine) and np.allclose(got[g]["q"], np.quantile(mine, probs))
    assert np.allclose(counting.quantile_dict(df, ["x"], probs, distinct_limit=limit)["x"], np.quantile([x for _, x in rows if x is not None], probs))
