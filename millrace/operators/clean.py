"""Missing values, duplicates and outliers. Statistics are fitted in one aggregate and applied lazily."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators import series
from millrace.operators.profile import column_metadata
from millrace.plans.counting import is_numeric, num, quantile_dict, value_counts
from millrace.plans.hashing import hash_unit

STATISTIC_FILLS = ("mean", "median", "mode")


def null_representations(df: DataFrame, cols: list[str], text: str) -> DataFrame:
    """Values equal to a listed token, as text or as a number, become null."""
    tokens = [t.strip() for t in text.split(",") if t.strip()]
    numbers = []
    for t in tokens:
        try:
            numbers.append(float(t))
        except ValueError:
            pass
    def hit(c: str) -> Column:
        as_text = F.col(c).cast("string").isin(tokens)
        return as_text | F.coalesce(F.col(c).try_cast("double").isin(numbers), F.lit(False)) if numbers else as_text
    return df.withColumns({c: F.when(~F.coalesce(hit(c), F.lit(False)), F.col(c)) for c in cols})


def suggest_actions(df: DataFrame) -> DataFrame:
    """(column, pct_miss, action): none, drop_column above 50 %, drop_rows below 5 %, else median or mode."""
    meta = column_metadata(df)
    action = (F.when(F.col("missing") == 0, "none").when(F.col("pct_miss") > 50, "drop_column")
              .when(F.col("pct_miss") < 5, "drop_rows")
              .when(F.col("dtype").isin("tinyint", "smallint", "int", "bigint", "float", "double"), "median").otherwise("mode"))
    return meta.select("column", "pct_miss", action.alias("action"))


def fit_fills(df: DataFrame, actions: dict[str, str]) -> dict[str, object]:
    """Fill value per column for mean, median and mode: one aggregate, plus one count of values when a
    median or mode is asked for. The mode is the smallest of the most frequent values."""
    kinds = dict(df.dtypes)
    values: dict[str, object] = {}
    means = [c for c, a in actions.items() if a == "mean" and is_numeric(kinds[c])]
    if means:
        row = df.agg(*[F.avg(num(c)).alias(c) for c in means]).first()
        values.update({c: row[c] for c in means})
    medians = [c for c, a in actions.items() if a == "median" and is_numeric(kinds[c])]
    if medians:
        values.update({c: q[0] for c, q in quantile_dict(df, medians, [0.5]).items()})
    for cast, cols in (("double", [c for c, a in actions.items() if a in ("mode", "most_frequent") and is_numeric(kinds[c])]),
                       ("string", [c for c, a in actions.items() if a in ("mode", "most_frequent") and not is_numeric(kinds[c])])):
        if cols:
            best = F.min(F.struct((-F.col("n")).alias("k"), F.col("value").alias("v"))).alias("b")
            values.update({r["column"]: r["b"]["v"] for r in value_counts(df, cols, cast).groupBy("column").agg(best).collect()})
    return values


def apply_fill(df: DataFrame, col: str, value) -> DataFrame:
    """Null and NaN become ``value``; an integer column stays integer only when the value is whole."""
    kind = dict(df.dtypes)[col]
    if value is None:
        return df
    if is_numeric(kind):
        whole = float(value).is_integer() and kind not in ("float", "double")
        base = F.col(col) if whole else num(col)
        return df.withColumn(col, F.coalesce(base, F.lit(value).cast(kind if whole else "double")))
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(value).cast(kind)))


def clean(df: DataFrame, actions: dict[str, str], order: list[str] | None = None, by: list[str] = (),
          constant: str = "MISSING") -> DataFrame:
    """Column by column, left to right. Fills between two ``drop_rows`` share one statistics job; a
    ``drop_rows`` changes the rows the later statistics see, so it closes the group."""
    out, batch = df, {}

    def flush(frame: DataFrame) -> DataFrame:
        values = fit_fills(frame, batch)
        for c, a in batch.items():
            frame = apply_fill(frame, c, values.get(c)) if a not in ("zero", "constant") else \
                apply_fill(frame, c, (0 if is_numeric(dict(frame.dtypes)[c]) else "0") if a == "zero" else constant)
        batch.clear()
        return frame

    for c, action in actions.items():
        if action in (*STATISTIC_FILLS, "most_frequent", "zero", "constant"):
            batch[c] = action
        elif action == "drop_rows":
            out = flush(out)
            keep = num(c).isNotNull() if dict(out.dtypes)[c] in ("float", "double") else F.col(c).isNotNull()
            out = out.filter(keep)
        elif action == "drop_column":
            out = flush(out).drop(c)
        elif action == "flag_zero":
            out = flag_missing(flush(out), c)
        elif action in ("ffill", "bfill"):
            out = series.fill(flush(out), [c], order or [], by, "forward" if action == "ffill" else "backward")
        elif action in ("interpolate", "interpolate_time"):
            out = series.interpolate(flush(out), c, order or [], by,
                                     (order or [None])[0] if action == "interpolate_time" else None)
        elif action != "none":
            raise ValueError(f"unknown action {action!r}")
    return flush(out)


def flag_missing(df: DataFrame, col: str) -> DataFrame:
    """``{col}_missing`` 0/1, then null becomes zero."""
    x = num(col) if dict(df.dtypes)[col] in ("float", "double") else F.col(col)
    flagged = df.withColumn(f"{col}_missing", x.isNull().cast("int"))
    return apply_fill(flagged, col, 0 if is_numeric(dict(df.dtypes)[col]) else "0")


# outliers ---------------------------------------------------------------------------------------------

def fit_fences(df: DataFrame, cols: list[str], k: float = 1.5) -> dict[str, tuple[float, float]]:
    """Q1 - k IQR and Q3 + k IQR per column."""
    q = quantile_dict(df, cols, [0.25, 0.75])
    return {c: (v[0] - k * (v[1] - v[0]), v[1] + k * (v[1] - v[0])) for c, v in q.items()}


def fit_percentile_fences(df: DataFrame, cols: list[str], low: float = 0.01, high: float = 0.99):
    return {c: (v[0], v[1]) for c, v in quantile_dict(df, cols, [low, high]).items()}


def clip(df: DataFrame, fences: dict[str, tuple[float, float]]) -> DataFrame:
    """Null stays null."""
    return df.withColumns({c: F.when(num(c).isNotNull(), F.least(F.greatest(num(c), F.lit(a)), F.lit(b)))
                           for c, (a, b) in fences.items()})


def drop_outside(df: DataFrame, fences: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows outside any fence, or null in a fenced column, are dropped."""
    for c, (a, b) in fences.items():
        df = df.filter(num(c).between(a, b))
    return df


def fit_zscore(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[f(num(c)).alias(f"{c}|{i}") for c in cols for i, f in enumerate((F.avg, F.stddev_samp))]).first()
    return {c: (row[f"{c}|0"], row[f"{c}|1"]) for c in cols}


def drop_zscore(df: DataFrame, moments: dict[str, tuple[float, float]], limit: float = 3.0) -> DataFrame:
    """Keep |z| <= limit. Null rows go too; a constant column is skipped."""
    for c, (m, s) in moments.items():
        if s:
            df = df.filter(F.abs((num(c) - F.lit(m)) / F.lit(s)) <= limit)
    return df


def outside(col: str, fence: tuple[float, float]) -> Column:
    return F.coalesce((num(col) < F.lit(fence[0])) | (num(col) > F.lit(fence[1])), F.lit(False))


def flag_outliers(df: DataFrame, fences: dict[str, tuple[float, float]]) -> DataFrame:
    """``{col}_is_outlier`` 0/1; null is 0."""
    return df.withColumns({f"{c}_is_outlier": outside(c, f).cast("int") for c, f in fences.items()})


def outlier_report(df: DataFrame, fences: dict[str, tuple[float, float]]) -> DataFrame:
    """(column, outliers, ratio): ratio over the non-null rows."""
    cols = list(fences)
    row = df.agg(*[a for i, c in enumerate(cols) for a in (
        F.sum(outside(c, fences[c]).cast("long")).alias(f"o{i}"), F.count(num(c)).alias(f"n{i}"))])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"o{i}").alias("outliers"),
                      F.coalesce(F.try_divide(F.col(f"o{i}"), F.col(f"n{i}")), F.lit(0.0)).alias("ratio"))
             for i, c in enumerate(cols)]
    return row.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def fit_winsor(df: DataFrame, cols: list[str], tail: float = 0.05) -> dict[str, tuple[float, float]]:
    """The (floor(tail·n)+1)-th smallest and largest values: limits by rank, not by interpolation."""
    counts = df.agg(*[F.count(num(c)).alias(c) for c in cols]).first()
    ranks = {c: (int(tail * counts[c]) / max(counts[c] - 1, 1), (counts[c] - 1 - int(tail * counts[c])) / max(counts[c] - 1, 1)) for c in cols if counts[c]}
    probs = sorted({p for pair in ranks.values() for p in pair})
    found = quantile_dict(df, list(ranks), probs) if ranks else {}
    return {c: (found[c][probs.index(low)], found[c][probs.index(high)]) for c, (low, high) in ranks.items()}


# duplicates -------------------------------------------------------------------------------------------

def _digest(cols: list[str]) -> Column:
    """md5 over the values; null differs from every text."""
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"}))


def drop_duplicates(df: DataFrame, order: list[str], subset: list[str] | None = None, keep: str = "first") -> DataFrame:
    """Keep the first or last row of each group of equal ``subset`` values, or none of a repeated group.

    A plain aggregate on a digest of the values with map-side combining: copies collapse before the shuffle,
    however many there are. ``order`` decides what first means and is not part of the default subset.
    """
    subset = subset or [c for c in df.columns if c not in order]
    rank = F.struct(*[F.col(c) for c in order])
    pick = F.max_by if keep == "last" else F.min_by
    groups = df.groupBy(_digest(subset).alias("_key")).agg(pick(F.struct(*[F.col(c) for c in df.columns]), rank).alias("_row"),
                                     F.count(F.lit(1)).alias("_n"))
    if keep == "none":
        groups = groups.filter(F.col("_n") == 1)
    return groups.select("_row.*")


def flag_duplicates(df: DataFrame, order: list[str], subset: list[str] | None = None) -> DataFrame:
    """``is_duplicate`` 0 for the first of each group, 1 for the others.

    The rows are matched back on the unique ``order`` columns, never on the repeated values.
    """
    subset = subset or [c for c in df.columns if c not in order]
    firsts = (df.groupBy(_digest(subset).alias("_key")).agg(F.min(F.struct(*[F.col(c) for c in order])).alias("_o"))
              .select("_o.*"))
    marked = df.join(firsts.withColumn("_first", F.lit(0)), order, "left")
    return marked.withColumn("is_duplicate", F.coalesce("_first", F.lit(1))).drop("_first").select(*df.columns, "is_duplicate")


def sample_share(df: DataFrame, keys: list[str], share: float, seed: int = 42) -> DataFrame:
    """About ``share`` of the rows by hash threshold: no sort, no count."""
    return df.filter(hash_unit(keys, seed) < share)
