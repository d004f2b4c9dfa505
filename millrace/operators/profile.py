"""Column kinds, metadata, descriptions and balance reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace.plans.counting import is_numeric, num, quantiles, value_counts

SKETCH_LOG2 = 16         # two to this many registers
SKETCH_ERROR = 0.0041    # their relative standard deviation
KINDS = ("numeric", "categorical", "datetime", "binary", "id_like", "text")


def scalar_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "vector", "binary"))]


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if is_numeric(t)]


def column_metadata(df: DataFrame, cols: list[str] | None = None, exact: bool = True, lengths: bool = True) -> DataFrame:
    """(column, dtype, kind, non_null, missing, pct_miss, n_unique, mean_length), one row per column.

    Two scans: one fused aggregate and one count of distinct values, both combined on the map side.
    ``exact=False`` replaces the second by sketches in the first; without ``lengths`` only text has a mean length. NaN counts as missing.
    A kind recorded in the column metadata wins over the inferred one.
    """
    cols = cols or scalar_columns(df)
    types = dict(df.dtypes)
    present = {c: num(c) if types[c] in ("float", "double") else F.col(c) for c in cols}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        length = F.avg(F.length(F.col(c).cast("string"))) if lengths or types[c] == "string" else F.lit(None).cast("double")
        aggs += [F.count(present[c]).alias(f"k{i}"), length.alias(f"l{i}")]
        if not exact:
            digest = F.when(present[c].isNotNull(), F.xxhash64(present[c]))
            aggs.append(F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(digest, F.lit(SKETCH_LOG2))), F.lit(0)).alias(f"u{i}"))
    stats = df.agg(*aggs)
    chosen = {f.name: f.metadata.get("kind") for f in df.schema}
    per_column = [F.struct(
        F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), F.col(f"k{i}").alias("non_null"),
        (F.col("rows") - F.col(f"k{i}")).alias("missing"), F.col(f"l{i}").alias("mean_length"),
        F.lit(chosen[c]).cast("string").alias("chosen"),
        (F.lit(None).cast("long") if exact else F.col(f"u{i}")).alias("n_unique"),
        F.col("rows").alias("rows")) for i, c in enumerate(cols)]
    meta = stats.select(F.explode(F.array(*per_column)).alias("m")).select("m.*")
    if exact:
        meta = meta.drop("n_unique").join(F.broadcast(distinct_counts(df, cols)), "column", "left").fillna(0, ["n_unique"])
    meta = meta.withColumn("kind", F.coalesce("chosen", kind_rule()))
    return meta.select("column", "dtype", "kind", "non_null", "missing",
                       F.coalesce(F.try_divide(F.col("missing") * 100.0, F.col("rows")), F.lit(0.0)).alias("pct_miss"),
                       "n_unique", "mean_length")


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n_unique): exact counts of the distinct non-null values (NaN is null) of columns that have any, in one scan.

    Each cell is dealt by its own type, so numbers and times need not become text; long text is counted by its digest, so that
    whole documents are not shuffled."""
    types = dict(df.dtypes)

    def cell(i: int, c: str) -> Column:
        t, x = types[c], F.col(c)
        whole = x.cast("long") if t in ("tinyint", "smallint", "int", "bigint", "boolean") else F.unix_date(x).cast("long") if t == "date" else None
        real = num(c) if t in ("float", "double") else None
        text = None if whole is not None or real is not None else F.when(F.length(x) > 32, F.md5(x)).otherwise(x) if t == "string" else x.cast("string")
        sides = [(whole, "long"), (real, "double"), (text, "string")]
        return F.struct(F.lit(i).alias("_c"), *[(F.lit(None).cast(k) if v is None else v).alias(f"_{k}") for v, k in sides])

    keys = ["_c", "_long", "_double", "_string"]
    cells = df.select(F.explode(F.array(*[cell(i, c) for i, c in enumerate(cols)])).alias("c")).select("c.*")
    seen = cells.filter("_long IS NOT NULL OR _double IS NOT NULL OR _string IS NOT NULL").groupBy(*keys).agg(F.lit(1).alias("one"))
    return seen.groupBy("_c").agg(F.count(F.lit(1)).alias("n_unique")).select(F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("_c") + 1).alias("column"), "n_unique")


def kind_rule(rule: str = "full") -> Column:
    """Kind from dtype, distinct count, non-null count and mean length.

    ``simple`` is the second rule in use: text iff at least 100 distinct values, id_like on the ratio over
    all rows, without the more-than-50 guard.
    """
    t, u = F.col("dtype"), F.col("n_unique")
    when = t.startswith("timestamp") | (t == "date")
    is_num = t.isin("tinyint", "smallint", "int", "bigint", "float", "double") | t.startswith("decimal")
    two = (t == "boolean") | (u == 2)
    if rule == "simple":
        ratio = F.coalesce(F.try_divide(u, F.col("non_null") + F.col("missing")), F.lit(0.0))
        return (F.when(when, "datetime").when(two, "binary").when(ratio > 0.95, "id_like")
                .when(is_num, "numeric").when(u >= 100, "text").otherwise("categorical"))
    ratio = F.coalesce(F.try_divide(u, F.col("non_null")), F.lit(0.0))
    return (F.when(when, "datetime").when(two, "binary")
            .when(is_num & (ratio > 0.95) & (u > 50), "id_like").when(is_num, "numeric")
            .when((ratio > 0.90) & (F.col("mean_length") > 20), "text")
            .when((ratio > 0.95) & (u > 50), "id_like").otherwise("categorical"))


def column_kinds(df: DataFrame, rule: str = "full", exact: bool = True) -> DataFrame:
    """(column, kind). A sketch of each column's distinct values decides where it is far from the thresholds of the rule; only the columns near
    one are counted exactly, so that a nearly unique column is not shuffled. ``exact=False`` trusts the sketches."""
    cols, choose = scalar_columns(df), (F.col("kind") if rule == "full" else kind_rule(rule)).alias("kind")
    meta = column_metadata(df, cols, exact=False, lengths=False)
    if not exact:
        return meta.select("column", choose)
    rows = meta.collect()   # one per column
    near = [r["column"] for r in rows if _near_threshold(r["n_unique"], r["non_null"], r["non_null"] + r["missing"])]
    counts = {r["column"]: r["n_unique"] for r in distinct_counts(df, near).collect()} if near else {}
    settled = [(*r, counts.get(r["column"], 0) if r["column"] in near else r["n_unique"]) for r in rows]
    schema = meta.schema.add("settled", "long")
    chosen = {f.name: f.metadata.get("kind") for f in df.schema}
    known = df.sparkSession.createDataFrame(settled, schema).withColumn("n_unique", F.col("settled"))
    ruled = known.withColumn("kind", kind_rule(rule))
    return ruled.select("column", reduce(lambda e, c: F.when(F.col("column") == c, F.lit(chosen[c])).otherwise(e), [c for c in cols if chosen[c] and rule == "full"], F.col("kind")).alias("kind"))


def _near_threshold(seen: int, non_null: int, rows: int) -> bool:
    """Might the exact count lie on the other side of a threshold? Sketches err by ``SKETCH_ERROR``, four times that is allowed for."""
    if seen <= 200:     # few values: counting them costs little, and the limits of 2, 50 and 100 are there
        return True
    off = 4 * SKETCH_ERROR * seen
    return any(abs(seen - share * n) <= off for share in (0.90, 0.95) for n in (non_null, rows))


def kinds_dict(df: DataFrame, exact: bool = True) -> dict[str, str]:
    """Kinds on the driver: one entry per column."""
    return {r["column"]: r["kind"] for r in column_kinds(df, exact=exact).collect()}


def describe_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max); std with n-1; nulls and NaN ignored."""
    cols = cols or numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = num(c)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"m{i}").alias("mean"),
                              F.col(f"s{i}").alias("std"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max"))
                     for i, c in enumerate(cols)])
    base = df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")
    q = quantiles(df, cols, [0.25, 0.5, 0.75]).drop("n")
    return (base.join(F.broadcast(q), "column", "left")
            .select("column", "count", "mean", "std", "min", F.col("q")[0].alias("q25"),
                    F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max"))


def describe_categorical(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, count, unique, top, freq); the smallest of equally frequent values is the top."""
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("v"))).alias("best")
    return (value_counts(df, cols).groupBy("column")
            .agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best)
            .select("column", "count", "unique", F.col("best.v").alias("top"), (-F.col("best.neg")).alias("freq")))


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing values, worst first. One aggregate, then as many rows as columns."""
    cols = scalar_columns(df)
    types = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("rows")] + [
        F.count(num(c) if types[c] in ("float", "double") else F.col(c)).alias(f"k{i}") for i, c in enumerate(cols)]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), (F.col("rows") - F.col(f"k{i}")).alias("missing"),
                              F.try_divide((F.col("rows") - F.col(f"k{i}")) * 100.0, F.col("rows")).alias("pct"))
                     for i, c in enumerate(cols)])
    return (df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*").filter(F.col("missing") > 0)
            .orderBy(F.desc("missing"), "column"))


def top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """(value, n, share) of the most frequent values; the share is over all non-null rows."""
    present = df.filter(F.col(col).isNotNull())
    total = present.count()
    return (present.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("share", F.col("n") / F.lit(max(total, 1))).orderBy(F.desc("n"), "value").limit(n))


def class_balance(df: DataFrame, cols: list[str] | None = None, max_classes: int = 20) -> DataFrame:
    """(column, classes, largest_share, verdict) for non-float columns with at most ``max_classes`` values."""
    cols = cols or [c for c, t in df.dtypes if c in scalar_columns(df) and t not in ("float", "double")]
    bounded = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first() if cols else {}
    few = [c for c in cols if bounded[c] <= 2 * max_classes + 20]  # far above any sketch error at 20
    if not few:
        return df.sparkSession.createDataFrame([], "column string, classes long, largest_share double, verdict string")
    rep = (value_counts(df, few).groupBy("column")
           .agg(F.count(F.lit(1)).alias("classes"), (F.max("n") / F.sum("n")).alias("largest_share"))
           .filter(F.col("classes") <= max_classes))
    verdict = F.when(F.col("largest_share") > 0.9, "severe").when(F.col("largest_share") > 0.75, "moderate").otherwise("ok")
    return rep.withColumn("verdict", verdict)


def balance_before_after(before: DataFrame, after: DataFrame, target: str) -> DataFrame:
    """(stage, class, n) on both frames."""
    def counts(df, stage):
        return df.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(stage).alias("stage"), "class", "n")
    return counts(before, "before").unionByName(counts(after, "after"))


def dataset_summary(frames: dict[str, DataFrame]) -> DataFrame:
    """(dataset, rows, columns, first_columns) per named frame."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("dataset"), "rows", F.lit(len(df.columns)).alias("columns"),
        F.lit(", ".join(df.columns[:5])).alias("first_columns")) for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
