"""Scalers: ``fit_*`` runs one aggregate and returns numbers per column, ``*_expr`` is a plain expression."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from millrace.plans.counting import num, quantile_dict, value_counts
from millrace.plans.lineage import cut

Params = dict[str, tuple]


def _fit(df: DataFrame, cols: list[str], *aggs) -> Params:
    row = df.agg(*[a(num(c)).alias(f"v{i}_{j}") for i, c in enumerate(cols) for j, a in enumerate(aggs)]).first()
    k = len(aggs)
    return {c: tuple(row[i * k:(i + 1) * k]) for i, c in enumerate(cols)}


def _ratio(top: Column, bottom: float | None) -> Column:
    """Constant columns scale to 0."""
    if not bottom:
        return F.when(top.isNotNull(), F.lit(0.0))
    return top / F.lit(bottom)


def fit_moments(df: DataFrame, cols: list[str], ddof: int = 0) -> Params:
    return _fit(df, cols, F.avg, F.stddev_pop if ddof == 0 else F.stddev_samp)


def standard_expr(col: str, p: Params) -> Column:
    mean, sd = p[col]
    return _ratio(num(col) - F.lit(mean), sd)


def fit_min_max(df: DataFrame, cols: list[str]) -> Params:
    return _fit(df, cols, F.min, F.max)


def min_max_expr(col: str, p: Params) -> Column:
    lo, hi = p[col]
    return _ratio(num(col) - F.lit(lo), None if lo is None else hi - lo)


def fit_robust(df: DataFrame, cols: list[str]) -> Params:
    q = quantile_dict(df, cols, [0.25, 0.5, 0.75])
    return {c: (q[c][1], q[c][2] - q[c][0]) if c in q else (None, None) for c in cols}


def robust_expr(col: str, p: Params) -> Column:
    """(x - median) / IQR; a zero IQR only centres."""
    median, iqr = p[col]
    return (num(col) - F.lit(median)) / F.lit(iqr or 1.0)


def fit_max_abs(df: DataFrame, cols: list[str]) -> Params:
    return _fit(df, cols, lambda x: F.max(F.abs(x)))


def max_abs_expr(col: str, p: Params) -> Column:
    return _ratio(num(col), p[col][0])


def apply_scaler(df: DataFrame, expr, params: Params, suffix: str = "") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": expr(c, params) for c in params})


# power transforms -------------------------------------------------------------------------------------

def _power(x: Column, lam: Column) -> Column:
    """(x**lam - 1) / lam, its limit log x at 0."""
    return F.when(F.abs(lam) < 1e-9, F.log(x)).otherwise((F.pow(x, lam) - 1) / lam)


def yeo_johnson(x: Column, lam: Column | float) -> Column:
    lam = F.lit(lam) if isinstance(lam, float) else lam
    return F.when(x >= 0, _power(x + 1, lam)).when(x < 0, -_power(1 - x, 2 - lam))


def box_cox(x: Column, lam: Column | float) -> Column:
    """Defined for positive values, null elsewhere."""
    lam = F.lit(lam) if isinstance(lam, float) else lam
    return F.when(x > 0, _power(x, lam))


def _peak(points: list[tuple[float, float]], step: float) -> float:
    """Top of the parabola through the best point and its two neighbours."""
    i = max(range(len(points)), key=lambda k: points[k][1])
    if i in (0, len(points) - 1):
        return points[i][0]
    a, b, c = (points[i + k][1] for k in (-1, 0, 1))
    bend = a - 2 * b + c
    return points[i][0] + (step * (a - c) / (2 * bend) if bend else 0.0)


def fit_power(df: DataFrame, cols: list[str], method: str = "yeo-johnson") -> Params:
    """(lambda, mean, sd) per column by maximum likelihood.

    The distinct values are counted once. A first round scores 21 values of lambda per column over the
    counts, two more score five around the top of the parabola through the best three.
    """
    yj = method == "yeo-johnson"
    f = yeo_johnson if yj else box_cox
    counts = value_counts(df, cols, "double")
    counts = cut(counts if yj else counts.filter(F.col("value") > 0))
    x, lam, w = F.col("value"), F.col("lam"), F.col("n")
    jac = F.signum(x) * F.log1p(F.abs(x)) if yj else F.log(x)
    base = {r["column"]: r for r in counts.groupBy("column").agg(
        F.sum(w).alias("n"), F.sum(w * jac).alias("j"), (F.sum(w * x) / F.sum(w)).alias("m")).collect()}
    best = {c: 0.0 for c in base}
    for step, reach in ((0.5, 10), (0.1, 2), (0.01, 2)):
        grid = df.sparkSession.createDataFrame(
            [(c, best[c] + step * k, base[c]["m"]) for c in base for k in range(-reach, reach + 1)],
            "column string, lam double, m double")
        d = f(x, lam) - f(F.col("m"), lam)  # centred at the image of the mean, for precision
        scores: dict[str, list] = {}
        for r in (counts.join(F.broadcast(grid), "column").select("column", "lam", "n", d.alias("d"))
                  .groupBy("column", "lam").agg(F.sum(w * F.col("d")).alias("s"), F.sum(w * F.col("d") * F.col("d")).alias("q"))
                  .collect()):
            b = base[r["column"]]
            var = r["q"] / b["n"] - (r["s"] / b["n"]) ** 2
            if var > 0 and math.isfinite(var):
                scores.setdefault(r["column"], []).append((r["lam"], -b["n"] / 2 * math.log(var) + (r["lam"] - 1) * b["j"]))
        best.update({c: _peak(sorted(v), step) for c, v in scores.items()})
    row = df.agg(*[a(f(num(c), best[c])).alias(f"m{i}{k}") for i, c in enumerate(best)
                   for k, a in enumerate((F.avg, F.stddev_pop))]).first()
    return {c: (best[c], row[f"m{i}0"], row[f"m{i}1"]) for i, c in enumerate(best)}


def power_expr(col: str, p: Params, method: str = "yeo-johnson") -> Column:
    lam, mean, sd = p[col]
    f = yeo_johnson if method == "yeo-johnson" else box_cox
    return _ratio(f(num(col), lam) - F.lit(mean), sd)


# quantile transform -----------------------------------------------------------------------------------

def fit_quantile(df: DataFrame, cols: list[str], n_quantiles: int = 1000) -> dict[str, list[float]]:
    """At most 1000 landmarks per column, fewer when there are fewer rows."""
    rows = df.count()
    k = max(min(n_quantiles, rows), 2)
    return quantile_dict(df, cols, [i / (k - 1) for i in range(k)])


def quantile_expr(col: str, p: dict[str, list[float]], output: str = "uniform") -> Column:
    """Position among the landmarks; ties take the middle of their range, outside values the ends."""
    marks = np.asarray(p[col], dtype=float)
    ref = np.linspace(0.0, 1.0, len(marks))
    inv = NormalDist().inv_cdf

    @F.pandas_udf("double")
    def place(x: pd.Series) -> pd.Series:
        v = x.to_numpy(dtype=float)
        u = 0.5 * (np.interp(v, marks, ref) - np.interp(-v, -marks[::-1], -ref[::-1]))
        u[v <= marks[0]], u[v >= marks[-1]] = 0.0, 1.0
        if output == "normal":
            ok = ~np.isnan(u)
            u[ok] = [inv(t) for t in np.clip(u[ok], 1e-7, 1 - 1e-7)]
        return pd.Series(u).where(~np.isnan(v), None)

    return place(num(col))


# expressions without statistics -----------------------------------------------------------------------

def log1p_expr(col: str) -> Column:
    return F.when(num(col) > -1, F.log1p(num(col)))


def sqrt_expr(col: str) -> Column:
    return F.when(num(col).isNotNull(), F.sqrt(F.greatest(num(col), F.lit(0.0))))


def binarise_expr(col: str, threshold: float = 0.0) -> Column:
    return (num(col) > threshold).cast("int")


def normalise_rows(df: DataFrame, cols: list[str], norm: str = "l2", suffix: str = "") -> DataFrame:
    """Divide each row by the norm of the chosen columns; a zero row stays zero."""
    if norm == "l1":
        size = sum([F.abs(num(c)) for c in cols], F.lit(0.0))
    else:
        size = F.sqrt(sum([num(c) * num(c) for c in cols], F.lit(0.0)))
    size = F.when(size == 0, F.lit(1.0)).otherwise(size)
    return df.withColumns({f"{c}{suffix}": num(c) / size for c in cols})


def polynomial(df: DataFrame, cols: list[str]) -> DataFrame:
    """Degree 2 without bias, in the order a, b, a², ab, b²; products are named ``a b`` and ``a^2``."""
    new = {}
    for i, a in enumerate(cols):
        for b in cols[i:]:
            new[f"{a}^2" if a == b else f"{a} {b}"] = num(a) * num(b)
    return df.withColumns(new)
