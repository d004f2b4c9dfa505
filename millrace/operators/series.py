"""Order-dependent operators: ``order`` must be unique inside each ``by`` group.

Every function goes through ``plans.ordering``, so a group of any size is cut into blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.functions import dates
from millrace.operators.charts import box, span
from millrace.plans.counting import num
from millrace.plans.ordering import BLOCK_ROWS, Ordered, ordered


def rolling_mean(df: DataFrame, col: str, order: list[str], by: list[str] = (), windows: list[int] = (3,),
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``{col}_ma{w}`` over the last w non-null values; null until there are w. Null rows are left out."""
    o = ordered(df.filter(num(col).isNotNull()), list(by), list(order), block_rows).with_halo(before=max(windows) - 1)
    out = o.df
    for w in windows:
        frame = o.window().rowsBetween(-(w - 1), 0)
        out = out.withColumn(f"{col}_ma{w}", F.when(F.count(F.lit(1)).over(frame) == w, F.avg(num(col)).over(frame)))
    return o.done(out)


def lags(df: DataFrame, col: str, order: list[str], by: list[str] = (), steps: list[int] = (1, 2, 3),
         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``{col}_lag{k}`` columns, null at the start of a group."""
    o = ordered(df, list(by), list(order), block_rows).with_halo(before=max(steps))
    return o.done(o.df.withColumns({f"{col}_lag{k}": F.lag(col, k).over(o.window()) for k in steps}))


def autocorrelation_pairs(df: DataFrame, col: str, order: list[str], lag: int, by: list[str] = (),
                          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(by..., order..., y, y_lag) with y_lag = the value ``lag`` rows later, both non-null."""
    o = ordered(df, list(by), list(order), block_rows).with_halo(after=lag)
    out = o.done(o.df.withColumn("y_lag", F.lead(num(col), lag).over(o.window())))
    return out.select(*by, *order, num(col).alias("y"), "y_lag").dropna(subset=["y", "y_lag"])


def autocorrelation(df: DataFrame, col: str, order: list[str], lag: int, by: list[str] = ()) -> DataFrame:
    return autocorrelation_pairs(df, col, order, lag, by).agg(F.corr("y", "y_lag").alias("r"),
                                                              F.count(F.lit(1)).alias("n"))


def seasonal_box(df: DataFrame, col: str, time: str) -> DataFrame:
    """Box statistics per calendar month."""
    return box(df.withColumn("month", F.month(dates.as_time(df, time))), col, "month")


def series_points(df: DataFrame, time: str, col: str, buckets: int | None = None) -> DataFrame:
    """(time, y) in time order; with ``buckets`` the mean per equal time slice."""
    t = dates.as_time(df, time)
    data = df.select(t.alias("t"), num(col).alias("y")).dropna()
    if not buckets:
        return data.orderBy("t")
    data = data.withColumn("_s", dates.epoch_seconds(F.col("t")))
    (lo, hi), = span(data, F.col("_s"))
    width = max((hi - lo) / buckets, 1e-9)
    return (data.groupBy(F.least(F.floor((F.col("_s") - lo) / F.lit(width)), F.lit(buckets - 1)).cast("long").alias("bucket"))
            .agg(F.min("t").alias("t"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bucket"))


def fill(df: DataFrame, cols: list[str], order: list[str], by: list[str] = (), direction: str = "forward",
         limit: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Forward or backward fill, at most ``limit`` steps when given. NaN counts as missing."""
    forward = direction == "forward"
    kinds = dict(df.dtypes)
    src = {c: num(c).cast(kinds[c]) if kinds[c] in ("double", "float") else F.col(c) for c in cols}
    o = ordered(df, list(by), list(order), block_rows)
    if limit is not None:
        o = o.with_halo(before=limit if forward else 0, after=0 if forward else limit)
        lo, hi = (-limit, 0) if forward else (0, limit)
    else:
        lo, hi = (W.unboundedPreceding, 0) if forward else (0, W.unboundedFollowing)
        for c in cols:
            o = o.carried(f"_carry_{c}", src[c], forward)
    pick = F.last if forward else F.first
    frame = o.window().rowsBetween(lo, hi)
    new = {}
    for c in cols:
        near = pick(src[c], ignorenulls=True).over(frame)
        new[c] = F.coalesce(src[c], near, F.col(f"_carry_{c}")) if limit is None else F.coalesce(src[c], near)
    return o.done(o.df.withColumns(new))


def interpolate(df: DataFrame, col: str, order: list[str], by: list[str] = (), time: str | None = None,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Linear by row position, or by ``time``. Leading gaps stay null, trailing ones repeat the last value."""
    o = ordered(df, list(by), list(order), block_rows)
    if time:
        pos: Column = dates.epoch_time(dates.as_time(df, time))
    else:
        pos = o.position().cast("double")
    o = Ordered(o.df.withColumn("_pos", pos).withColumn("_pt", F.when(
        num(col).isNotNull(), F.struct(F.col("_pos").alias("p"), num(col).alias("v")))), o.by, o.order, o.split,
        o.block_rows, [*o.helpers, "_pos", "_pt"])
    o = o.carried("_cb", F.col("_pt"), True).carried("_ca", F.col("_pt"), False)
    w = o.window()
    before = F.coalesce(F.last("_pt", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.col("_cb"))
    after = F.coalesce(F.first("_pt", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)), F.col("_ca"))
    out = o.df.withColumn("_b", before).withColumn("_a", after)
    share = F.try_divide(F.col("_pos") - F.col("_b.p"), F.col("_a.p") - F.col("_b.p"))
    value = (F.when(num(col).isNotNull(), num(col)).when(F.col("_b").isNull(), F.lit(None).cast("double"))
             .when(F.col("_a").isNull(), F.col("_b.v"))
             .otherwise(F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * F.coalesce(share, F.lit(0.0))))
    return o.done(out.withColumn(col, value)).drop("_b", "_a")


def seasonal_decompose(df: DataFrame, col: str, order: list[str], by: list[str] = (), period: int = 12,
                       block_rows: int = BLOCK_ROWS) -> DataFrame:
    """trend (centred moving average), seasonal (mean detrended value per phase, centred) and residual.

    An even period averages two neighbouring windows. Trend and residual are null at both ends.
    """
    by = list(by)
    half = period // 2
    base = df.filter(num(col).isNotNull())
    o = ordered(base, by, list(order), block_rows)
    o = Ordered(o.df.withColumn("_i", o.position()), o.by, o.order, o.split, o.block_rows, [*o.helpers, "_i"])
    h = o.with_halo(before=half, after=half)
    y, w = num(col), h.window()
    full = F.count(F.lit(1)).over(w.rowsBetween(-half, half)) == 2 * half + 1
    total = F.sum(y).over(w.rowsBetween(-half, half))
    if period % 2 == 0:
        ends = F.lag(y, half).over(w) + F.lead(y, half).over(w)
        trend = (total - ends / 2) / period
    else:
        trend = total / period
    h.helpers.remove("_i")
    out = h.done(h.df.withColumn("trend", F.when(full, trend)))
    out = out.withColumn("phase", (F.col("_i") - 1) % period).drop("_i")
    phase = out.groupBy(*by, "phase").agg(F.avg(num(col) - F.col("trend")).alias("_s"))
    level = phase.groupBy(*by).agg(F.avg("_s").alias("_m")) if by else phase.agg(F.avg("_s").alias("_m"))
    if by:
        phase = phase.join(level, by)
    else:
        phase = phase.withColumn("_m", F.lit(level.first()[0]))
    phase = phase.select(*by, "phase", (F.col("_s") - F.col("_m")).alias("seasonal"))
    joined = out.join(phase, [*by, "phase"], "left") if by else out.join(F.broadcast(phase), "phase", "left")
    return joined.withColumn("residual", num(col) - F.col("trend") - F.col("seasonal"))
