"""Order-dependent work without unbounded window partitions.

A window over one key runs in one task. Keys are measured first and rows are split by the heat of their key: rows
of small keys use an ordinary window and are written nowhere; rows of keys above ``block_rows`` get a position
through a range partitioning and each such key is cut into blocks of ``block_rows`` consecutive rows. Bounded
frames then take a halo of neighbouring rows, unbounded frames take a carry (one row per block).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.plans.keys import join_on
from millrace.plans.lineage import cut
from millrace.plans.lookup import BROADCAST_ROWS

BLOCK_ROWS = 1_000_000


def _order_cols(order: list[str]) -> list[Column]:
    """``"x"`` ascending, ``"-x"`` descending; nulls first ascending as in Spark."""
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def by_heat(df: DataFrame, by: list[str], block_rows: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(cold, hot): the rows of keys with at most ``block_rows`` rows and those of larger keys; None where empty.

    There are fewer hot keys than rows / block_rows; they are counted before they are broadcast, and beyond
    ``BROADCAST_ROWS`` of them all rows count as hot. Null is a key like any other.
    """
    if not by:
        return (df, None) if df.count() <= block_rows else (None, df)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_heat")).filter(F.col("_heat") > block_rows)
    keys = cut(sizes.select(*by))
    n = keys.count()
    if n == 0:
        return df, None
    if n > BROADCAST_ROWS:
        return None, df
    return tuple(join_on(df, F.broadcast(keys), by, how) for how in ("left_anti", "left_semi"))


def prefix_totals(df: DataFrame, by: list[str], order: list[str], add: dict[str, Column]) -> DataFrame:
    """Running totals over ``order`` within ``by`` (current row included), any group size.

    ``order`` must be unique within ``by``. Rows are range-partitioned on (by, order), so a hot group
    spans many tasks; only one total per (group, partition) is combined across tasks.
    """
    keyed = df
    for name, expr in add.items():
        keyed = keyed.withColumn(f"_v_{name}", expr)
    ranged = cut(keyed.repartitionByRange(*[F.col(b) for b in by], *_order_cols(order))
                 .withColumn("_pid", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "_pid").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in add])
    before = W.partitionBy(*by).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*by, "_pid", *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in add])
    within = W.partitionBy(*by, "_pid").orderBy(*_order_cols(order)).rowsBetween(W.unboundedPreceding, 0)
    running = ranged.select("*", *[F.sum(f"_v_{n}").over(within).alias(f"_w_{n}") for n in add])
    out = join_on(running, offsets, [*by, "_pid"], "inner")
    for n in add:
        out = out.withColumn(n, F.col(f"_w_{n}") + F.col(f"_o_{n}")).drop(f"_v_{n}", f"_w_{n}", f"_o_{n}")
    return out.drop("_pid")


def running_totals(df: DataFrame, by: list[str], order: list[str], add: dict[str, Column],
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``prefix_totals`` for the rows of large keys, an ordinary window for all others."""
    by = list(by)
    cold, hot = by_heat(df, by, block_rows)
    w = W.partitionBy(*by).orderBy(*_order_cols(order)).rowsBetween(W.unboundedPreceding, 0)
    return _both(None if cold is None else cold.select("*", *[F.sum(expr).over(w).alias(n) for n, expr in add.items()]),
                 None if hot is None else prefix_totals(hot, by, order, add))


def _both(cold: DataFrame | None, hot: DataFrame | None) -> DataFrame:
    return cold if hot is None else hot if cold is None else cold.unionByName(hot)


@dataclass
class Ordered:
    df: DataFrame
    by: list[str]
    order: list[str]
    split: bool
    block_rows: int
    helpers: list[str] = field(default_factory=list)

    def window(self):
        return W.partitionBy(*self.by, "_blk").orderBy(*_order_cols(self.order))

    def position(self) -> Column:
        """1-based position in the group; a cold group is one block, so its row number is the position."""
        own = F.row_number().over(self.window()).cast("long")
        return F.coalesce(F.col("_rn"), own) if self.split else own

    def with_halo(self, before: int = 0, after: int = 0) -> "Ordered":
        """Copy the edge rows of each block into its neighbours, so bounded frames are complete."""
        if not self.split:
            return Ordered(self.df.withColumn("_halo", F.lit(False)), self.by, self.order, False,
                           self.block_rows, [*self.helpers, "_halo"])
        if max(before, after) > self.block_rows:
            raise ValueError("frame is longer than a block; raise block_rows")
        pos = (F.col("_rn") - 1) % self.block_rows
        homes = F.array(
            F.col("_blk"),
            F.when(pos >= self.block_rows - before, F.col("_blk") + 1) if before else F.lit(None).cast("long"),
            F.when(pos < after, F.col("_blk") - 1) if after else F.lit(None).cast("long"))
        spread = (self.df.withColumn("_home", F.explode(F.array_compact(homes)))
                  .withColumn("_halo", F.col("_home") != F.col("_blk"))
                  .withColumn("_blk", F.col("_home")).drop("_home"))
        return Ordered(spread, self.by, self.order, True, self.block_rows, [*self.helpers, "_halo"])

    def carried(self, name: str, value: Column, forward: bool = True) -> "Ordered":
        """Add ``name``: the nearest non-null ``value`` in earlier (or later) blocks of the group."""
        if not self.split:
            return Ordered(self.df.withColumn(name, F.when(F.lit(False), value)), self.by, self.order,
                           False, self.block_rows, [*self.helpers, name])
        pick = F.max_by if forward else F.min_by
        have = self.df.filter(F.col("_rn").isNotNull()).withColumn("_cv", value)
        edge = have.groupBy(*self.by, "_blk").agg(
            pick("_cv", F.when(F.col("_cv").isNotNull(), F.col("_rn"))).alias("_edge"))
        w = W.partitionBy(*self.by).orderBy("_blk" if forward else F.col("_blk").desc()) \
             .rowsBetween(W.unboundedPreceding, -1)
        edge = edge.select(*self.by, "_blk", F.last("_edge", ignorenulls=True).over(w).alias(name))
        return Ordered(join_on(self.df, edge, [*self.by, "_blk"], "left"), self.by, self.order, True,
                       self.block_rows, [*self.helpers, name])

    def done(self, df: DataFrame) -> DataFrame:
        if "_halo" in df.columns and self.split:
            df = df.filter(~F.col("_halo"))
        return df.drop("_blk", "_rn", *self.helpers)


def ordered(df: DataFrame, by: list[str], order: list[str], block_rows: int = BLOCK_ROWS) -> Ordered:
    by = list(by or [])
    cold, hot = by_heat(df, by, block_rows)
    if hot is None:
        return Ordered(df.withColumn("_blk", F.lit(0).cast("long")), by, order, False, block_rows)
    numbered = prefix_totals(hot, by, order, {"_rn": F.lit(1).cast("long")})
    blocked = numbered.withColumn("_blk", F.floor((F.col("_rn") - 1) / block_rows).cast("long"))
    if cold is not None:  # one block without positions, which no halo or carry touches
        cold = cold.withColumn("_rn", F.lit(None).cast("long")).withColumn("_blk", F.lit(0).cast("long"))
    return Ordered(_both(cold, blocked), by, order, True, block_rows)


def row_numbers(df: DataFrame, by: list[str], order: list[str], name: str,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """1-based position inside ``by``; ``order`` unique within the group."""
    by = list(by or [])
    cold, hot = by_heat(df, by, block_rows)
    place = F.row_number().over(W.partitionBy(*by).orderBy(*_order_cols(order))).cast("long")
    return _both(None if cold is None else cold.withColumn(name, place),
                 None if hot is None else prefix_totals(hot, by, order, {name: F.lit(1).cast("long")}))
