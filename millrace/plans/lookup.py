"""Joining rows to a per-key table whose size is measured before it is broadcast."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from millrace.plans.lineage import cut

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20   # as JSON text: rows of lists or vectors are large, however few
HOT_KEYS = 1_000


@dataclass
class Lookup:
    """``table`` has the key column(s), ``n`` (rows per key in the fitted data) and value columns."""
    table: DataFrame
    keys: list[str]
    small: bool
    total: int


def fit_lookup(table: DataFrame, keys: list[str], limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> Lookup:
    """Materialise a per-key aggregate (with its count column ``n``) and measure its rows and bytes."""
    saved = cut(table)
    width = F.length(F.to_json(F.struct(*saved.columns)))
    size, total, held = saved.agg(F.count(F.lit(1)), F.sum("n"), F.sum(width.cast("long"))).first()
    return Lookup(saved, keys, size <= limit and (held or 0) <= most_bytes, int(total or 0))


def join_lookup(df: DataFrame, lk: Lookup, keep: list[str]) -> DataFrame:
    """Left join ``keep`` onto ``df``. Null keys find nothing.

    A small table is broadcast. Otherwise keys holding more than 1/1000 of the rows, of which there are
    fewer than 1000, go through a broadcast and the rest through a shuffle.
    """
    table = lk.table.select(*lk.keys, *keep)
    if lk.small:
        return df.join(F.broadcast(table), lk.keys, "left").select(*df.columns, *keep)
    hot = lk.table.filter(F.col("n") > lk.total / HOT_KEYS).select(*lk.keys, *keep)
    of_hot = df.join(F.broadcast(hot), lk.keys, "inner").select(*df.columns, *keep)
    rest = df.join(F.broadcast(hot.select(*lk.keys)), lk.keys, "left_anti")
    spread = [F.when(F.col(k).isNull(), F.rand(7)).otherwise(F.lit(0.0)) for k in lk.keys]
    # null keys match nothing; spread them so they do not meet in one task
    rest = rest.withColumn("_nk", F.floor(sum(spread[1:], spread[0]) * 1000).cast("int"))
    cold = table.withColumn("_nk", F.lit(0))
    joined = rest.join(cold, [*lk.keys, "_nk"], "left").select(*df.columns, *keep)
    return of_hot.unionByName(joined)
