"""Category, flag and date encoders as fit / apply pairs.

A fitted encoder is a table with one row per category. It is materialised and measured once; joining it
broadcasts when small and splits off the hot keys otherwise (``plans.lookup``). Null categories stay null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.functions import dates
from millrace.plans.counting import num
from millrace.plans.lookup import Lookup, fit_lookup, join_lookup
from millrace.plans.ordering import row_numbers

MAX_CARDINALITY = 500


def _per_category(df: DataFrame, col: str, *aggs) -> DataFrame:
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"), *aggs)


def _joined(df: DataFrame, lk: Lookup, renames: dict[str, str]) -> DataFrame:
    hidden = {f"_enc_{v}": k for k, v in renames.items()}
    table = lk.table.withColumns({h: F.col(src) for h, src in hidden.items()})
    out = join_lookup(df, Lookup(table, lk.keys, lk.small, lk.total), list(hidden))
    return out.withColumns({h.removeprefix("_enc_"): F.col(h) for h in hidden}).drop(*hidden)


def fit_counts(df: DataFrame, col: str) -> Lookup:
    return fit_lookup(_per_category(df, col), [col])


def apply_counts(df: DataFrame, col: str, lk: Lookup, out: str) -> DataFrame:
    return _joined(df, lk, {"n": out})


def apply_frequency(df: DataFrame, col: str, lk: Lookup, out: str) -> DataFrame:
    """Share of the non-null rows."""
    counted = _joined(df, lk, {"n": out})
    return counted.withColumn(out, F.col(out) / F.lit(float(max(lk.total, 1))))


def fit_categories(df: DataFrame, col: str, limit: int = MAX_CARDINALITY) -> list:
    """Sorted distinct values; more than ``limit`` of them is an error, not a cut."""
    values = [r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(values) > limit:
        raise ValueError(f"{col} has more than {limit} categories; use another encoding")
    return sorted(values)


def one_hot(df: DataFrame, col: str, categories: list) -> DataFrame:
    """``{col}_{value}`` columns in sorted order; null and unknown give zeros everywhere."""
    return df.withColumns({f"{col}_{v}": F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0))
                           for v in categories}).drop(col)


def fit_labels(df: DataFrame, col: str) -> Lookup:
    """code = 0-based place in sorted order."""
    coded = row_numbers(_per_category(df, col), [], [col], "code").withColumn("code", F.col("code") - 1)
    return fit_lookup(coded, [col])


def apply_labels(df: DataFrame, col: str, lk: Lookup, out: str, unknown: int | None = None) -> DataFrame:
    """Label codes; ``unknown=-1`` gives the ordinal encoder's value for unseen and null categories."""
    coded = _joined(df, lk, {"code": out})
    return coded if unknown is None else coded.withColumn(out, F.coalesce(F.col(out), F.lit(unknown).cast("long")))


def fit_target(df: DataFrame, col: str, target: str, smoothing: float = 1.0, min_leaf: int = 20,
               method: str = "sigmoid") -> tuple[Lookup, float]:
    """Smoothed category means and the overall mean.

    ``sigmoid``: prior * (1 - w) + mean * w with w = 1 / (1 + exp(-(n - min_leaf) / smoothing)).
    ``m``: (sum + smoothing * prior) / (n + smoothing).
    """
    prior = df.agg(F.avg(num(target))).first()[0]
    per = _per_category(df.filter(num(target).isNotNull()), col, F.sum(num(target)).alias("s"))
    n, s = F.col("n"), F.col("s")
    if method == "m":
        value = (s + smoothing * F.lit(prior)) / (n + smoothing)
    else:
        w = 1 / (1 + F.exp(-(n - min_leaf) / F.lit(smoothing)))
        value = F.lit(prior) * (1 - w) + s / n * w
    return fit_lookup(per.withColumn("value", value), [col]), prior


def apply_target(df: DataFrame, col: str, fitted: tuple[Lookup, float], out: str) -> DataFrame:
    lk, prior = fitted
    return _joined(df, lk, {"value": out}).withColumn(out, F.coalesce(F.col(out), F.lit(prior)))


def leave_one_out(train: DataFrame, col: str, target: str, out: str, apply_to: DataFrame | None = None) -> DataFrame:
    """Training rows: mean of the other rows of the category, overall mean when there are none.
    Other frames (``apply_to``): the plain category mean, overall mean when unseen."""
    prior = train.agg(F.avg(num(target))).first()[0]
    lk = fit_lookup(_per_category(train.filter(num(target).isNotNull()), col, F.sum(num(target)).alias("s")), [col])
    df = train if apply_to is None else apply_to
    j = _joined(df, lk, {"s": "_s", "n": "_n"})
    if apply_to is None:
        value = F.when(F.col("_n") > 1, (F.col("_s") - num(target)) / (F.col("_n") - 1))
    else:
        value = F.col("_s") / F.col("_n")
    return j.withColumn(out, F.coalesce(value, F.lit(prior))).drop("_s", "_n")


def base_n(df: DataFrame, col: str, lk: Lookup, base: int = 2) -> DataFrame:
    """Digits of code + 1, most significant first, as ``{col}_0`` ...; null and unseen are all 0."""
    size = lk.table.count()
    width = 1
    while base ** width <= size:
        width += 1
    coded = apply_labels(df, col, lk, "_code")
    digits = {f"{col}_{i}": F.expr(f"cast((coalesce(_code + 1, 0) div {base ** (width - 1 - i)}) % {base} as int)")
              for i in range(width)}
    return coded.withColumns(digits).drop("_code")


def hashing(df: DataFrame, col: str, components: int = 8) -> DataFrame:
    """One-hot of md5(value) modulo ``components``; null gives zeros. No fitting."""
    bucket = F.conv(F.substring(F.md5(F.col(col).cast("string")), 1, 8), 16, 10).cast("long") % components
    return df.withColumns({f"{col}_{i}": F.coalesce((bucket == i).cast("int"), F.lit(0)) for i in range(components)})


def bool_map(df: DataFrame, col: str, out: str) -> DataFrame:
    """yes / True to 1, everything else to 0. Exactly these spellings."""
    text = F.col(col).cast("string")
    truth = ["yes", "True"] if dict(df.dtypes)[col] != "boolean" else ["true"]
    return df.withColumn(out, F.coalesce(text.isin(truth).cast("int"), F.lit(0)))


def date_basic(df: DataFrame, col: str) -> DataFrame:
    t = dates.as_time(df, col)
    return df.withColumns({f"{col}_year": dates.part(t, "Year"), f"{col}_month": dates.part(t, "Month"),
                           f"{col}_day": dates.part(t, "Day")}).drop(col)


def date_full(df: DataFrame, col: str) -> DataFrame:
    t = dates.as_time(df, col)
    names = {"year": "Year", "month": "Month", "day": "Day", "dow": "DayOfWeek", "hour": "Hour",
             "is_weekend": "IsWeekend"}
    return df.withColumns({f"{col}_{k}": dates.part(t, v) for k, v in names.items()}).drop(col)


def date_epoch(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, dates.epoch_seconds(dates.as_time(df, col)))


def date_cycle(df: DataFrame, col: str) -> DataFrame:
    s, c = dates.month_cycle(dates.as_time(df, col))
    return df.withColumns({f"{col}_month_sin": s, f"{col}_month_cos": c}).drop(col)


def default_plan(kinds: dict[str, str], numeric: str = "standard") -> dict[str, str]:
    """Encoder per column from its kind."""
    rule = {"id_like": "drop", "categorical": "one_hot", "numeric": numeric, "datetime": "date_full",
            "binary": "label", "text": "passthrough"}
    return {c: rule[k] for c, k in kinds.items()}


def apply_plan(df: DataFrame, plan: dict[str, str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Run a plan. Statistics come from ``fitted_on`` (default: the frame itself)."""
    from millrace.operators import scale
    base = df if fitted_on is None else fitted_on
    fits = {"standard": (scale.fit_moments, scale.standard_expr), "minmax": (scale.fit_min_max, scale.min_max_expr),
            "robust": (scale.fit_robust, scale.robust_expr)}
    out = df
    for name, (fit, expr) in fits.items():
        cols = [c for c, m in plan.items() if m == name]
        if cols:
            out = scale.apply_scaler(out, expr, fit(base, cols))
    for c, m in plan.items():
        if m == "drop":
            out = out.drop(c)
        elif m == "one_hot":
            out = one_hot(out, c, fit_categories(base, c))
        elif m == "label":
            out = apply_labels(out, c, fit_labels(base, c), c)
        elif m == "bool_map":
            out = bool_map(out, c, c)
        elif m == "date_full":
            out = date_full(out, c)
    return out
