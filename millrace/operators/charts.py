"""The data tables behind the charts: bins, densities, boxes, cross-tabs, scatter samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.plans.counting import num, quantiles
from millrace.plans.hashing import kth_smallest, within_cutoff
from millrace.plans.lineage import cut
from millrace.plans.lookup import fit_lookup, join_lookup

KDE_BINS = 4096


def span(df: DataFrame, *cols: Column) -> list[tuple[float, float]]:
    """Minimum and maximum of each expression, in one aggregate."""
    row = df.agg(*[f(c) for c in cols for f in (F.min, F.max)]).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(cols))]


def bin_index(x: Column, lo: float, hi: float, n: int) -> Column:
    """0-based equal-width bin, the last one closed on the right; a constant column is all bin 0."""
    if hi == lo:
        return F.when(x.isNotNull(), F.lit(0)).cast("long")
    width = (hi - lo) / n
    return F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(n - 1)).cast("long")


def histogram(df: DataFrame, col: str, bins: int = 30, hue: str | None = None, log: bool = False) -> DataFrame:
    """([hue,] bin, left, right, n) for occupied bins; ``log`` bins log10 of the positive values."""
    x = num(col)
    x = F.when(x > 0, F.log10(x)) if log else x
    data = df.select(x.alias("_x"), *([hue] if hue else [])).filter(F.col("_x").isNotNull())
    (lo, hi), = span(data, F.col("_x"))
    keys = ([hue] if hue else []) + ["bin"]
    if lo is None:
        lo = hi = 0.0
    width = (hi - lo) / bins
    left = F.lit(lo) + F.col("bin") * F.lit(width)
    out = (data.withColumn("bin", bin_index(F.col("_x"), lo, hi, bins)).groupBy(*keys)
           .agg(F.count(F.lit(1)).alias("n")))
    return out.select(*keys, left.alias("left"), (left + F.lit(width)).alias("right"), "n")


def _binned(df: DataFrame, col: str, bins: int, hue: str | None):
    x = num(col)
    data = df.select(x.alias("_x"), *([hue] if hue else [])).filter(F.col("_x").isNotNull())
    keys = [hue] if hue else []
    (lo, hi), = span(data, F.col("_x"))
    lo, hi = (lo, hi) if lo is not None else (0.0, 0.0)
    width = (hi - lo) / bins
    centre = F.lit(lo) + (F.col("_b") + 0.5) * F.lit(width) if width else F.lit(lo)
    cells = (data.withColumn("_b", bin_index(F.col("_x"), lo, hi, bins)).groupBy(*keys, "_b")
             .agg(F.count(F.lit(1)).alias("_n"), F.sum("_x").alias("_s"), F.sum(F.col("_x") ** 2).alias("_s2"))
             .withColumn("_c", centre))
    return cells, keys, lo, hi


def density(df: DataFrame, col: str, hue: str | None = None, points: int = 200, bins: int = KDE_BINS,
            grid: tuple[float, float] | None = None) -> DataFrame:
    """([hue,] x, density): Gaussian kernel, Scott bandwidth n**(-1/5) * std per hue.

    The rows are folded into at most ``bins`` cells per hue first, so the kernel sums run over
    bins × points whatever the number of rows. The grid spans the data, or ``grid`` when given.
    """
    cells, keys, lo, hi = _binned(df, col, bins, hue)
    lo, hi = grid or (lo, hi)
    step = (hi - lo) / (points - 1)
    stats = cells.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_s").alias("s"), F.sum("_s2").alias("s2"))
    var = (F.col("s2") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    stats = stats.filter(F.col("n") > 1).withColumn("bw", F.sqrt(var) * F.pow(F.col("n"), F.lit(-0.2))) \
                 .filter(F.col("bw") > 0)
    if keys:
        lk = fit_lookup(stats, keys)
        weighted = join_lookup(cells, lk, ["bw"]).join(
            F.broadcast(lk.table.select(*keys, F.col("n").alias("_tot"))), keys) if lk.small else \
            cells.join(lk.table.select(*keys, "bw", F.col("n").alias("_tot")), keys)
    else:
        one = stats.first()
        bw, tot = (one["bw"], one["n"]) if one else (None, None)
        weighted = cells.withColumn("bw", F.lit(bw).cast("double")).withColumn("_tot", F.lit(tot).cast("double"))
    spread = weighted.filter(F.col("bw").isNotNull()).select(
        *keys, "_n", "_c", "bw", "_tot", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    at = F.lit(lo) + F.col("i") * F.lit(step)
    z = (at - F.col("_c")) / F.col("bw")
    k = F.col("_n") * F.exp(-0.5 * z * z) / (F.col("_tot") * F.col("bw") * math.sqrt(2 * math.pi))
    return (spread.groupBy(*keys, "i").agg(F.sum(k).alias("density"))
            .select(*keys, (F.lit(lo) + F.col("i") * F.lit(step)).alias("x"), "density"))


def box(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """([by,] n, q1, median, q3, low, high, outliers): whiskers reach the last value within 1.5 IQR."""
    keys = [by] if by else []
    data = df.select(num(col).alias("_x"), *keys).filter(F.col("_x").isNotNull())
    q = quantiles(data, ["_x"], [0.25, 0.5, 0.75], by=keys).select(
        *keys, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    if by:
        lk = fit_lookup(q, keys)
        joined = join_lookup(data.filter(F.col(by).isNotNull()), lk, ["q1", "median", "q3"])
    else:
        r = q.first()
        joined = data.withColumns({k: F.lit(r[k] if r else None).cast("double") for k in ("q1", "median", "q3")})
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col("_x") >= F.col("q1") - 1.5 * iqr) & (F.col("_x") <= F.col("q3") + 1.5 * iqr)
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("q1").alias("q1"), F.max("median").alias("median"),
        F.max("q3").alias("q3"), F.min(F.when(inside, F.col("_x"))).alias("low"),
        F.max(F.when(inside, F.col("_x"))).alias("high"), F.sum((~inside).cast("long")).alias("outliers"))


def violin(df: DataFrame, col: str, by: str, points: int = 200) -> DataFrame:
    """Density per group with the group's quartiles on every row."""
    return density(df, col, by, points).join(F.broadcast(box(df, col, by).select(by, "q1", "median", "q3")), by)


def top_categories(df: DataFrame, col: str, k: int) -> list:
    """The ``k`` most frequent non-null values, ties by value (at most ``k`` on the driver)."""
    rows = (df.filter(F.col(col).isNotNull()).groupBy(col).count()
            .orderBy(F.desc("count"), col).limit(k).collect())
    return [r[0] for r in rows]


def crosstab(df: DataFrame, a: str, b: str, top: int | None = None, normalise: bool = False, wide: bool = False) -> DataFrame:
    """Counts of (a, b), of the ``top`` categories of each if given; shares of the row total when normalised. ``wide`` needs ``top``."""
    kept = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    if top or wide:
        va, vb = top_categories(df, a, top), top_categories(df, b, top)
        kept = df.filter(F.col(a).isin(va) & F.col(b).isin(vb))
    if wide:
        return kept.groupBy(a).pivot(b, vb).count().fillna(0)
    cells = kept.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    if not normalise:
        return cells
    return cells.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(a)))  # cells are counts, one per pair of categories


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, those first in hash order; a threshold filter, not a sort."""
    if df.count() <= n:
        return df
    return df.filter(within_cutoff(keys, seed, kth_smallest(df, keys, seed, {None: n})))


def scatter(df: DataFrame, cols: list[str], keys: list[str], n: int | None = None, seed: int = 42) -> DataFrame:
    """Complete rows of the chosen columns, optionally down to ``n`` points (swarm plots use 1000)."""
    full = df.dropna(subset=cols)
    return (sample_rows(full, keys, n, seed) if n else full).select(*dict.fromkeys([*keys, *cols]))


def pair_plot(df: DataFrame, cols: list[str], keys: list[str], n: int | None = None, max_columns: int | None = None) -> DataFrame:
    return scatter(df, cols[:max_columns], keys, n)


def hist2d(df: DataFrame, x: str, y: str, bins: int = 30) -> DataFrame:
    """(bx, by, n) of occupied cells."""
    data = df.select(num(x).alias("_x"), num(y).alias("_y")).dropna()
    (x0, x1), (y0, y1) = span(data, F.col("_x"), F.col("_y"))
    return (data.groupBy(bin_index(F.col("_x"), x0, x1, bins).alias("bx"),
                         bin_index(F.col("_y"), y0, y1, bins).alias("by")).agg(F.count(F.lit(1)).alias("n")))


def hexbin(df: DataFrame, x: str, y: str, gridsize: int = 30) -> DataFrame:
    """(hx, hy, n): occupied hexagons by centre; the nearer of the two offset lattices wins."""
    data = df.select(num(x).alias("_x"), num(y).alias("_y")).dropna()
    (x0, x1), (y0, y1) = span(data, F.col("_x"), F.col("_y"))
    rows = max(int(gridsize / math.sqrt(3)), 1)
    sx, sy = ((x1 - x0) / gridsize or 1.0), ((y1 - y0) / rows or 1.0)
    u, v = (F.col("_x") - F.lit(x0)) / F.lit(sx), (F.col("_y") - F.lit(y0)) / F.lit(sy)
    au, av = F.floor(u + 0.5), F.floor(v + 0.5)
    bu, bv = F.floor(u) + 0.5, F.floor(v) + 0.5
    da = (u - au) ** 2 + 3.0 * (v - av) ** 2
    db = (u - bu) ** 2 + 3.0 * (v - bv) ** 2
    hx = F.when(da < db, au.cast("double")).otherwise(bu)
    hy = F.when(da < db, av.cast("double")).otherwise(bv)
    return (data.select(hx.alias("_u"), hy.alias("_v")).groupBy("_u", "_v").agg(F.count(F.lit(1)).alias("n"))
            .select((F.lit(x0) + F.col("_u") * F.lit(sx)).alias("hx"),
                    (F.lit(y0) + F.col("_v") * F.lit(sy)).alias("hy"), "n"))


def density2d(df: DataFrame, x: str, y: str, cells: int = 30, points: int = 25) -> DataFrame:
    """(gx, gy, density): Gaussian kernel with the data covariance times n**(-1/3), over binned cells."""
    data = df.select(num(x).alias("_x"), num(y).alias("_y")).dropna()
    r = data.agg(F.count(F.lit(1)), F.var_samp("_x"), F.var_samp("_y"), F.covar_samp("_x", "_y"),
                 F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
    n, vx, vy, cxy, x0, x1, y0, y1 = r
    f = n ** (-1 / 3)
    a, b, c = vx * f, cxy * f, vy * f
    det = a * c - b * b
    wx, wy = (x1 - x0) / cells, (y1 - y0) / cells
    sx, sy = (x1 - x0) / (points - 1), (y1 - y0) / (points - 1)
    steps = F.sequence(F.lit(0), F.lit(points - 1))
    grid = (hist2d(df, x, y, cells).withColumn("cx", F.lit(x0) + (F.col("bx") + 0.5) * F.lit(wx))
            .withColumn("cy", F.lit(y0) + (F.col("by") + 0.5) * F.lit(wy))
            .withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps)))
    dx, dy = F.lit(x0) + F.col("i") * F.lit(sx) - F.col("cx"), F.lit(y0) + F.col("j") * F.lit(sy) - F.col("cy")
    m = (dx * dx * c - 2 * dx * dy * b + dy * dy * a) / det
    k = F.col("n") * F.exp(-0.5 * m) / (n * 2 * math.pi * math.sqrt(det))
    return (grid.groupBy("i", "j").agg(F.sum(k).alias("density"))
            .select((F.lit(x0) + F.col("i") * F.lit(sx)).alias("gx"),
                    (F.lit(y0) + F.col("j") * F.lit(sy)).alias("gy"), "density"))


def target_analysis(df: DataFrame, feature: str, target: str, kinds: dict[str, str]) -> DataFrame:
    """Box when one side is numeric, scatter rows when both are, row-normalised cross-tab otherwise."""
    fn, tn = kinds[feature] in ("numeric", "id_like"), kinds[target] in ("numeric", "id_like")
    if fn and tn:
        return df.select(feature, target).dropna()
    if fn:
        return box(df, feature, target)
    if tn:
        return box(df, target, feature)
    return crosstab(df, feature, target, normalise=True)


def target_rate(df: DataFrame, feature: str, target: str, top: int | None = None) -> DataFrame:
    """(category, n, rate, overall), lowest rate first; of the ``top`` most frequent categories if given.

    A two-class target counts its last class in sorted order as 1; any other target is read as a number.
    Rows with a null feature or target are left out.
    """
    data = df.select(F.col(feature).alias("_f"), F.col(target).alias("_t")).dropna()
    classes = [r[0] for r in data.select("_t").distinct().limit(3).collect()]
    y = (F.col("_t") == F.lit(max(classes))).cast("double") if len(classes) == 2 else F.col("_t").try_cast("double")
    per = cut(data.withColumn("_y", y).groupBy(F.col("_f").alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"), F.count("_y").alias("k")))
    total, known = per.agg(F.sum("s"), F.sum("k")).first()
    overall = total / known if known else None
    rates = per.select("category", "n", F.try_divide(F.col("s"), F.col("k")).alias("rate"))
    if top:
        rates = rates.orderBy(F.desc("n"), "category").limit(top)
    return rates.withColumn("overall", F.lit(overall)).orderBy("rate", "category")


def drift_numeric(a: DataFrame, b: DataFrame, col: str, points: int = 200) -> DataFrame:
    """(dataset, x, density) for both frames on one grid."""
    (a0, a1), = span(a, num(col))
    (b0, b1), = span(b, num(col))
    grid = (min(a0, b0), max(a1, b1))
    one = density(a, col, points=points, grid=grid).select(F.lit("a").alias("dataset"), "x", "density")
    return one.unionByName(density(b, col, points=points, grid=grid).select(F.lit("b").alias("dataset"), "x", "density"))


def drift_categorical(a: DataFrame, b: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """(value, share_a, share_b), absent values 0, the most frequent first; the first ``top`` if given."""
    def shares(df, name):
        present = df.filter(F.col(col).isNotNull())
        n = present.count()
        return present.groupBy(F.col(col).alias("value")).agg((F.count(F.lit(1)) / F.lit(max(n, 1))).alias(name))
    both = shares(a, "share_a").join(shares(b, "share_b"), "value", "full_outer").fillna(0.0, ["share_a", "share_b"])
    ordered = both.orderBy(F.desc("share_a"), F.desc("share_b"), "value")
    return ordered.limit(top) if top else ordered
