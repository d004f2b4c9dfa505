"""Seeded, engine-independent row order: md5 of the key and the seed.

The hash is uniform, so "the k smallest" and "position" are found from counts per hash prefix; there is
no global sort, whatever the size of a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.plans.keys import join_on

BUCKET_ROWS = 500_000


def hash_order(keys: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws("#", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def hash_unit(keys: list[str], seed: int) -> Column:
    """Uniform number in [0, 1) from the first eight hex digits."""
    return F.conv(F.substring(hash_order(keys, seed), 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))


def hash_numbered(df: DataFrame, keys: list[str], seed: int, name: str, by: list[str] = (),
                  bucket_rows: int = BUCKET_ROWS, rows: int | None = None) -> DataFrame:
    """Add ``name``: 1-based position in hash order inside ``by`` (``keys`` unique).

    Rows are bucketed by hash prefix sized to ``bucket_rows``; the window runs inside (by, bucket) and
    the bucket offsets come from a count table with one row per (by, bucket).
    """
    by = list(by)
    rows = df.count() if rows is None else rows
    digits = 0
    while rows / 16 ** digits > bucket_rows:
        digits += 1
    keyed = df.withColumn("_ord", hash_order(keys, seed))
    if digits == 0:
        w = W.partitionBy(*by).orderBy("_ord")
        return keyed.withColumn(name, F.row_number().over(w).cast("long")).drop("_ord")
    keyed = keyed.withColumn("_hb", F.substring("_ord", 1, digits))
    before = W.partitionBy(*by).orderBy("_hb").rowsBetween(W.unboundedPreceding, -1)
    offsets = (keyed.groupBy(*by, "_hb").agg(F.count(F.lit(1)).alias("_n"))
               .select(*by, "_hb", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    w = W.partitionBy(*by, "_hb").orderBy("_ord")
    ranked = keyed.withColumn("_pos", F.row_number().over(w))
    return (join_on(ranked, offsets, [*by, "_hb"], "inner")
            .withColumn(name, F.col("_pos") + F.col("_off")).drop("_ord", "_hb", "_pos", "_off"))


def class_map(values: dict) -> Column:
    """A small dictionary of classes (at most 1000) as a map column; look up with ``try_element_at``."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _class_column(by: str | None) -> Column:
    return F.col(by).cast("string") if by else F.lit("")


def kth_smallest(df: DataFrame, keys: list[str], seed: int, wanted: dict, by: str | None = None,
                 bucket_rows: int = BUCKET_ROWS) -> dict:
    """Per class, the hash of its k-th smallest row; ``wanted`` maps class -> k (``None`` = whole table).

    Prefix counts are narrowed a few hex digits at a time, so only the one bucket that holds the k-th row is
    ever sorted. The counts of one round are at most a few hundred thousand: the more classes, the fewer
    digits per round. Classes asked for must be few.
    """
    if len(wanted) > 1000:
        raise ValueError("too many classes for a stratified selection")
    base = df.select(_class_column(by).alias("c"), hash_order(keys, seed).alias("h"))
    name = {c if c is not None else "": c for c in wanted}
    out, todo = {}, {}
    for c, k in wanted.items():
        if k <= 0:
            out[c] = ""
        else:
            todo[c if c is not None else ""] = ("", k)
    digits = 4 if len(wanted) <= 8 else 3 if len(wanted) <= 100 else 2
    width = 0
    while todo:
        # all open classes have prefixes of one width
        step = 2 if width == 0 else digits
        inside = F.col("h").startswith(F.try_element_at(class_map({c: p for c, (p, _) in todo.items()}), F.col("c")))
        counts: dict = {}
        for r in base.filter(inside).groupBy("c", F.substring("h", 1, width + step).alias("p")).count().collect():
            counts.setdefault(r["c"], []).append((r["p"], r["count"]))
        ready, nxt = {}, {}
        width += step
        for c, (_, k) in todo.items():
            for p, n in sorted(counts.get(c, [])):
                if k <= n:
                    (ready if n <= bucket_rows or width >= 32 else nxt)[c] = (p, k)
                    break
                k -= n
            else:
                out[name[c]] = "g"  # every row is wanted; 'g' sorts after any hex digit
        if ready:
            prefix = F.try_element_at(class_map({c: p for c, (p, _) in ready.items()}), F.col("c"))
            want = F.try_element_at(class_map({c: k for c, (_, k) in ready.items()}), F.col("c"))
            place = F.row_number().over(W.partitionBy("c").orderBy("h"))
            rows = (base.filter(F.col("h").startswith(prefix)).withColumn("i", place).filter(F.col("i") == want)
                    .select("c", "h").collect())
            out.update({name[r["c"]]: r["h"] for r in rows})
        todo = nxt
    return out


def within_cutoff(keys: list[str], seed: int, cutoffs: dict, by: str | None = None) -> Column:
    """True for the rows at or before the cutoff hash of their class; false for a class without one."""
    limits = class_map({c if c is not None else "": v for c, v in cutoffs.items()})
    return F.coalesce(hash_order(keys, seed) <= F.try_element_at(limits, _class_column(by)), F.lit(False))
