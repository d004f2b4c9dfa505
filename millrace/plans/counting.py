"""Value counts, exact quantiles and ranks built on pre-aggregated values."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.plans.keys import join_on
from millrace.plans.lineage import cut
from millrace.plans.lookup import fit_lookup, join_lookup
from millrace.plans.ordering import BLOCK_ROWS, prefix_totals, running_totals

DISTINCT_LIMIT = 2_000_000
#: a KLL sketch of this size misses a rank by 0.07 % of the rows in one case of a hundred; brackets are three times as wide
SKETCH_K, SLACK = 8_192, 0.002
WHOLE_ROWS = 10_000          # groups up to this size are counted whole
MOST_PROBS = 40              # beyond, the brackets hold a good part of all values
MERGE_WAYS = 64
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def is_numeric(dtype: str) -> bool:
    return dtype in NUMERIC or dtype.startswith("decimal")


def num(name: str | Column) -> Column:
    """Column as double with NaN turned into NULL, so missing has one meaning."""
    c = F.col(name) if isinstance(name, str) else name
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def long_values(df: DataFrame, cols: list[str], cast: str, by: list[str] = ()) -> DataFrame:
    """(by..., column, value): one row per cell, made by a projection and an explode (no shuffle)."""
    cells = [F.struct(F.lit(c).alias("column"), (num(c) if cast == "double" else F.col(c).cast(cast)).alias("value"))
             for c in cols]
    return df.select(*by, F.explode(F.array(*cells)).alias("_cell")).select(*by, "_cell.*")


def value_counts(df: DataFrame, cols: list[str], cast: str = "string", by: list[str] = ()) -> DataFrame:
    """(by..., column, value, n) for non-null values; combined on the map side, so hot values are cheap."""
    return (long_values(df, cols, cast, by).filter(F.col("value").isNotNull())
            .groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n")))


def _at_ranks(counts: DataFrame, by: list[str], probs: list[float], small: bool) -> DataFrame:
    """(by..., q array, n, missed) from (by..., value, n, at): linear interpolation between order statistics. Rows are in the order of
    ``at``; a row without a value stands for many values between two others, and ``missed`` says that a rank fell there.
    ``small``: the rows of a group fit in one window."""
    if small:
        group = W.partitionBy(*by)
        run = counts.select("*", F.sum("n").over(group.orderBy("at").rowsBetween(W.unboundedPreceding, 0)).alias("cum"), F.sum("n").over(group).alias("total"))
    else:
        counts = cut(counts)
        run = prefix_totals(counts, by, ["at"], {"cum": F.col("n")})
        run = join_on(run, counts.groupBy(*by).agg(F.sum("n").alias("total")), by, "inner")
    run = run.withColumn("before", F.col("cum") - F.col("n"))
    if len(probs) > MOST_PROBS:
        return _at_many_ranks(run, counts, by, probs)

    def at(idx: Column) -> Column:
        return F.max(F.when((F.col("before") <= idx) & (idx < F.col("cum")), F.col("value")))

    parts = []
    for p in probs:
        pos = F.lit(float(p)) * (F.col("total") - 1)
        parts.append((at(F.floor(pos)), at(F.ceil(pos)), F.max(pos - F.floor(pos))))
    agg = run.groupBy(*by).agg(*[x.alias(f"_{k}{i}") for i, t in enumerate(parts) for k, x in zip("abf", t)],
                              F.max("total").alias("n"))
    step = lambda i: F.when(F.col(f"_f{i}") > 0, (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}")).otherwise(F.lit(0.0))
    q = F.array(*[F.col(f"_a{i}") + step(i) for i in range(len(probs))])
    missed = reduce(or_, [F.col(f"_{k}{i}").isNull() for i in range(len(probs)) for k in "ab"], F.lit(False))
    return agg.select(*by, q.alias("q"), "n", missed.alias("missed"))


def _at_many_ranks(run: DataFrame, counts: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """(by..., q array, n) as ``_at_ranks``, for counts without gaps: each rank is a row that meets the values of its run of
    ranks, so neither the plan nor the work per value grows with the number of probabilities."""
    runs = F.expr(f"greatest(total div {len(probs)}, 1)")   # ranks a run; about as many runs as probabilities
    total = counts.groupBy(*by).agg(F.sum("n").alias("total")).withColumn("_run", runs)
    ranks = (total.select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "_p"))
             .withColumn("_pos", F.col("_p") * (F.col("total") - 1)))
    ends = F.array(F.struct(F.lit(0).alias("end"), F.floor("_pos").alias("rank")), F.struct(F.lit(1).alias("end"), F.ceil("_pos").alias("rank")))
    wanted = ranks.select(*by, "_i", (F.col("_pos") - F.floor("_pos")).alias("_f"), "_run", F.explode(ends).alias("_e")).select(
        *by, "_i", "_f", "_e.*", F.expr("_e.rank div _run").alias("_block"))
    spans = run.withColumn("_run", runs).select(
        *by, "value", "before", "cum", "total", F.explode(F.expr("sequence(before div _run, (cum - 1) div _run)")).alias("_block"))
    found = join_on(spans, wanted, [*by, "_block"], "inner").filter("before <= rank and rank < cum")
    q = (found.groupBy(*by, "_i").agg(F.max(F.expr("if(end = 0, value, null)")).alias("_a"), F.max(F.expr("if(end = 1, value, null)")).alias("_b"),
                                      F.max("_f").alias("_f"), F.max("total").alias("n"))
         .withColumn("q", F.col("_a") + F.when(F.col("_f") > 0, (F.col("_b") - F.col("_a")) * F.col("_f")).otherwise(F.lit(0.0))))
    return q.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_i", "q")))["q"].alias("q"), F.max("n").alias("n"))


def quantile_brackets(df: DataFrame, cols: list[str], probs: list[float], by: list[str] = (), whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """(by..., n, lo0, hi0, lo1, ...): per column two arrays with ends that enclose the values at each probability, from one scan
    that builds a KLL sketch per column. Sketches are merged in ``MERGE_WAYS`` groups first, so that no task meets those
    of all partitions. Both arrays are null where a column has at most ``whole_rows`` values."""
    by = list(by)
    part = df.groupBy(*by, F.pmod(F.spark_partition_id(), F.lit(MERGE_WAYS)).alias("_way")).agg(
        F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(num(c), F.lit(SKETCH_K)).alias(f"_s{i}") for i, c in enumerate(cols)])
    whole = part.groupBy(*by).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(f"_s{i}", F.lit(SKETCH_K)).alias(f"_s{i}") for i in range(len(cols))])

    def ends(i: int, sign: int, limit: float) -> Column:
        ranks = [p + sign * SLACK for p in probs]
        inside = F.array(*[F.lit(min(max(r, 0.0), 1.0)) for r in ranks])
        found = F.kll_sketch_get_quantile_double(f"_s{i}", inside)
        outer = [F.get(found, k) if 0 < r < 1 else F.lit(limit) for k, r in enumerate(ranks)]
        return F.when(F.kll_sketch_get_n_double(f"_s{i}") > whole_rows, F.array(*outer))

    return whole.select(*by, "n", *[c for i in range(len(cols)) for c in (ends(i, -1, -math.inf).alias(f"lo{i}"), ends(i, 1, math.inf).alias(f"hi{i}"))])


def bracketed_counts(df: DataFrame, cols: list[str], probs: list[float], by: list[str] = (), whole_rows: int = WHOLE_ROWS) -> tuple[DataFrame, float]:
    """(by..., column, value, n, at): the number of each value inside the brackets, and of all values of each gap between them as
    one row without a value; ``at`` is the value or the smallest of the gap. Two scans of ``df``; only the brackets' values are
    shuffled, as the rest is combined into a few rows per task. Also about how many rows the largest group has."""
    by = list(by)
    found = quantile_brackets(df, cols, probs, by, whole_rows)
    if by:
        sides = [f"{k}{i}" for i in range(len(cols)) for k in ("lo", "hi")]
        plain = df.select(*by, *[num(c).alias(f"_x{i}") for i, c in enumerate(cols)])
        lookup = fit_lookup(found, by)
        most = lookup.table.agg(F.max("n")).first()[0] or 0
        frame = join_lookup(plain, lookup, sides)
        side = lambda k, i, j: F.get(F.col(f"{k}{i}"), j)
    else:
        ends = found.first()   # columns times probabilities numbers
        most = (ends["n"] if ends else 0) or 0
        frame = df.select(*[num(c).alias(f"_x{i}") for i, c in enumerate(cols)])
        side = lambda k, i, j: F.lit(None if ends is None or ends[f"{k}{i}"] is None else ends[f"{k}{i}"][j]).cast("double")
    cells = []
    for i in range(len(cols)):
        x = F.col(f"_x{i}")
        within = reduce(or_, [(x >= side("lo", i, j)) & (x <= side("hi", i, j)) for j in range(len(probs))])
        within = F.coalesce(within, F.lit(True))   # no brackets: every value is one's own
        gap = sum(((side("hi", i, j) < x).cast("int") for j in range(len(probs))), F.lit(0))
        cells.append(F.struct(F.lit(i).alias("_c"), F.when(within, x).alias("value"), F.when(~within, gap).alias("_gap"), x.alias("_x")))
    counts = (frame.select(*by, F.explode(F.array(*cells)).alias("_cell")).select(*by, "_cell.*").filter("_x IS NOT NULL")
              .groupBy(*by, "_c", "value", "_gap").agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("at")))
    named = counts.select(*by, F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("_c") + 1).alias("column"), "value", "n", "at")
    return named, min(most, max(whole_rows, most * 3 * SLACK * len(probs)))


def quantiles(df: DataFrame, cols: list[str], probs: list[float], by: list[str] = (),
              distinct_limit: int = DISTINCT_LIMIT, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """Exact quantiles (linear interpolation): (by..., column, q array<double>, n).

    A sketch brackets each quantile, a second scan counts the values inside the brackets and how many lie between them; the
    ranks decide. Were a rank outside of its bracket, which a sketch makes improbable but not impossible, all values are counted.
    So they are for more probabilities than brackets could separate. Up to ``distinct_limit`` counted values of a
    group are ranked in one window, more through range partitions.
    """
    by, keys = list(by), [*by, "column"]
    if 0 < len(probs) <= MOST_PROBS:
        counts, most = bracketed_counts(df, cols, probs, by, whole_rows)
        out = _at_ranks(counts, keys, probs, most <= distinct_limit)
        if by:
            out = cut(out)
            missed = not out.filter("missed").isEmpty()
        else:
            rows = out.collect()   # one per column
            missed = any(r["missed"] for r in rows)
            out = df.sparkSession.createDataFrame(rows, out.schema)
        if not missed:
            return out.drop("missed")
    counts = cut(value_counts(df, cols, "double", by)).withColumn("at", F.col("value"))
    return _at_ranks(counts, keys, probs, counts.count() <= distinct_limit).drop("missed")


def quantile_dict(df: DataFrame, cols: list[str], probs: list[float], **kw) -> dict[str, list[float]]:
    """Quantiles of whole columns on the driver: columns × probabilities numbers."""
    return {r["column"]: list(r["q"]) for r in quantiles(df, cols, probs, **kw).collect()}


def average_ranks(df: DataFrame, col: str, name: str, by: list[str] = (),
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(by..., col, name, n): 1-based average rank of each distinct non-null value."""
    by = list(by)
    counts = cut(df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("n")))
    run = running_totals(counts, by, [col], {"_cum": F.col("n")}, block_rows)
    return run.withColumn(name, F.col("_cum") - (F.col("n") - 1) / F.lit(2.0)).drop("_cum")
