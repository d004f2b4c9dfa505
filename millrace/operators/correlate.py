"""Correlation matrices: Pearson, Spearman and Kendall tau-b, each pair on its complete rows."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from millrace.plans.counting import num
from millrace.plans.lineage import cut
from millrace.plans.lookup import fit_lookup, join_lookup
from millrace.plans.ordering import row_numbers, running_totals


def pearson(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, r) for every unordered pair, all in one aggregate."""
    pairs = list(combinations(cols, 2))
    row = df.agg(*[F.corr(F.when(num(b).isNotNull(), num(a)), num(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"))
             for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _cells(df: DataFrame, a: str, b: str) -> DataFrame:
    return cut(df.select(num(a).alias("x"), num(b).alias("y")).dropna()
               .groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))


def _with_ranks(cells: DataFrame, col: str, name: str) -> DataFrame:
    totals = cells.groupBy(col).agg(F.sum("n").alias("n"))
    run = running_totals(totals, [], [col], {"cum": F.col("n")})
    ranks = run.select(col, "n", (F.col("cum") - (F.col("n") - 1) / 2.0).alias(name))
    return join_lookup(cells, fit_lookup(ranks, [col]), [name])


def spearman(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of average ranks, taken over the distinct value pairs with their counts."""
    out = None
    for a, b in combinations(cols, 2):
        r = _with_ranks(_with_ranks(_cells(df, a, b), "x", "rx"), "y", "ry")
        n = F.sum("n")
        mean = r.agg((n + 1) / 2.0).first()[0] or 0.0  # the mean of average ranks
        dx, dy = F.col("rx") - mean, F.col("ry") - mean
        one = r.agg(F.try_divide(F.sum(F.col("n") * dx * dy),
                                 F.sqrt(F.sum(F.col("n") * dx * dx) * F.sum(F.col("n") * dy * dy))).alias("r"))
        one = one.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "r")
        out = one if out is None else out.unionByName(one)
    return out


def kendall(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, r) with tau-b, exact and without comparing pairs.

    The second variable is replaced by its dense rank. Two rows differ first at exactly one bit of that
    rank, so concordant pairs are counted per (bit, prefix) group as "ones times earlier zeros" with
    running totals over the first variable: cells × bits rows in all.
    """
    out = None
    for a, b in combinations(cols, 2):
        cells = _cells(df, a, b)
        ys = cells.groupBy("y").agg(F.sum("n").alias("n"))
        distinct = ys.count()
        dense = row_numbers(ys, [], ["y"], "rk").withColumn("rk", F.col("rk") - 1)
        coded = join_lookup(cells, fit_lookup(dense, ["y"]), ["rk"])
        bits = max(math.ceil(math.log2(max(distinct, 2))), 1)
        level = F.explode(F.sequence(F.lit(0), F.lit(bits - 1)))
        split = coded.select("x", "n", "rk", level.alias("level"))
        bit = F.expr("shiftright(rk, level) & 1")
        by_x = (split.groupBy("level", F.expr("shiftright(rk, level + 1)").alias("prefix"), "x")
                .agg(F.sum(F.when(bit == 0, F.col("n")).otherwise(0)).alias("zeros"),
                     F.sum(F.when(bit == 1, F.col("n")).otherwise(0)).alias("ones")))
        by_x = cut(by_x)
        run = running_totals(by_x, ["level", "prefix"], ["x"], {"cz": F.col("zeros"), "co": F.col("ones")})
        # concordant: a one after earlier zeros; discordant: a zero after earlier ones
        f = lambda c: c.cast("double")
        cd = run.agg(F.sum(f(F.col("ones")) * f(F.col("cz") - F.col("zeros"))).alias("c"),
                     F.sum(f(F.col("zeros")) * f(F.col("co") - F.col("ones"))).alias("d"))
        pairs = lambda c: F.sum(f(c) * (f(c) - 1) / 2)
        tx = cells.groupBy("x").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("tx"), F.sum("n").alias("total"))
        c, d = cd.first()
        t1, total = tx.first()
        t2 = ys.agg(pairs(F.col("n"))).first()[0]
        n0 = (total or 0) * ((total or 0) - 1) / 2
        den = math.sqrt((n0 - (t1 or 0)) * (n0 - (t2 or 0))) if total else 0.0
        tau = (c - d) / den if den else None
        one = df.sparkSession.createDataFrame([(a, b, tau)], "a string, b string, r double")
        out = one if out is None else out.unionByName(one)
    return out
