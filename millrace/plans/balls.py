"""Covering points by balls of a given radius, and joining points within a distance, in any number of columns.

Points are dealt to blocks of bounded size by their nearest pivot, so near points tend to share a task. Only the size
of the cover depends on that; every point lies within the radius of its centre whatever the blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from millrace.plans.lineage import cut
from millrace.plans.neighbours import PIVOTS, _assign, no_rows, squared


def _pivots(points: DataFrame, key: str, v: str, blocks: int, turned: bool = False) -> np.ndarray:
    """A pivot per block, as far as ``PIVOTS``: the points with the smallest digests, or ``turned`` the largest."""
    order = F.col(key).desc() if turned else F.col(key)
    return np.array([r["v"] for r in points.orderBy(order).select(F.col(v).alias("v")).limit(min(PIVOTS, blocks)).collect()], dtype=float)


def _dealt(points: DataFrame, piv: np.ndarray, block: int) -> DataFrame:
    """``points`` with ``cell``, the nearest pivot, and ``b``, a part of about ``block`` points of the cell."""
    placed = cut(_assign(points, piv).drop("r"))
    sizes = F.broadcast(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nb")))  # one row per pivot
    return placed.join(sizes, "cell").withColumn("b", F.pmod(F.xxhash64("vk"), F.col("_nb"))).drop("_nb")


def near(q: np.ndarray, s: np.ndarray, eps: float) -> np.ndarray:
    """The boolean matrix of the pairs within eps, as from differences. A matrix product decides all pairs but those
    so close to the limit that its rounding could; they are computed again from their differences."""
    hits, limit = np.empty((len(q), len(s)), dtype=bool), eps * eps
    q2, s2 = (q * q).sum(1), (s * s).sum(1)
    slack = 1e-14 * (q.shape[1] + 4) * (q2.max(initial=0.0) + s2.max(initial=0.0) + limit)
    step = max(2_000_000 // max(len(s), 1), 1)
    with np.errstate(invalid="ignore", over="ignore"):
        for i in range(0, len(q), step):
            over = q2[i:i + step, None] + (s2 - limit)[None, :] - 2.0 * (q[i:i + step] @ s.T)
            part = over <= 0
            a, b = np.nonzero(~(np.abs(over) > slack))  # also what is no number
            for j in range(0, len(a), 200_000):
                x, y = a[j:j + 200_000], b[j:j + 200_000]
                part[x, y] = ((q[i + x] - s[y]) ** 2).sum(1) <= limit
            hits[i:i + step] = part
    return hits


def at_home(points: DataFrame, eps: float, block: int, work, schema: str, turned: bool = False) -> DataFrame:
    """``work(rows, rows, hits)`` for blocks of near points, each point in one block: some of the pairs within eps, at
    a cost in proportion to the points. ``turned`` deals them by other pivots."""
    piv = _pivots(points, "vk", "v", -(-points.count() // block), turned)
    if len(piv) == 0:
        return points.sparkSession.createDataFrame([], schema)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["v"].to_numpy())
        return work(rows, rows, near(x, x, eps))

    return _dealt(points, piv, block).groupBy("cell", "b").applyInPandas(meet, schema)


def _half_cover(points: DataFrame, radius: float, block: int) -> DataFrame:
    """(vk, v, centre, c): points (vk, v) with a centre within ``radius``, chosen greedily in each block."""
    piv = _pivots(points, "vk", "v", -(-points.count() // block))
    if len(piv) == 0:
        return points.select("vk", "v", F.col("vk").alias("centre"), F.col("v").alias("c"))
    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vk")
        x = np.stack(rows["v"].to_numpy())
        centre, left = np.empty(len(x), dtype=int), np.arange(len(x))
        while len(left):
            inside = ((x[left] - x[left[0]]) ** 2).sum(1) <= radius * radius
            centre[left[inside]] = left[0]
            left = left[~inside]
        vk, v = rows["vk"].to_numpy(), rows["v"].to_numpy()
        return pd.DataFrame({"vk": vk, "v": v, "centre": vk[centre], "c": v[centre]})

    return _dealt(points.select("vk", "v"), piv, block).groupBy("cell", "b").applyInPandas(choose, "vk string, v array<double>, centre string, c array<double>")


def cover(points: DataFrame, radius: float, block: int) -> DataFrame:
    """(vk, v, centre, c): every point within ``radius`` of its centre, itself a point.

    Two rounds of half the radius: the centres that the blocks of the first round chose are covered again, which
    joins the balls of neighbouring blocks.
    """
    first = cut(_half_cover(points, radius / 2, block))
    centres = first.select(F.col("centre").alias("vk"), F.col("c").alias("v")).dropDuplicates(["vk"])
    second = _half_cover(cut(centres), radius / 2, block)
    return first.drop("c").join(second.select(F.col("vk").alias("centre"), F.col("centre").alias("_top"), "c"), "centre").select(
        "vk", "v", F.col("_top").alias("centre"), "c")


def within(left: DataFrame, right: DataFrame, eps: float, block: int, work, schema: str) -> DataFrame:
    """``work(left rows, right rows, hits)`` for blocks of points (vk, v, ...) that together hold all pairs within ``eps``.

    A left point stays at its nearest pivot; a right one is copied to the pivots where a partner can be: those whose
    distance is at most that of their farthest left point plus eps, and at most its own nearest pivot's distance
    plus 2 eps (both by the triangle inequality). ``hits`` is the boolean matrix of the pairs within eps; no pair
    leaves a task unless ``work`` returns it. There is a pivot per block, so copies grow no faster than the blocks.
    """
    piv = _pivots(left, "vk", "v", -(-left.count() // block))
    if len(piv) == 0:
        return left.sparkSession.createDataFrame([], schema)
    at = cut(_assign(left, piv))
    far = {r["cell"]: r["u"] for r in at.groupBy("cell").agg(F.max("r").alias("u")).collect()}  # one row per pivot
    reach = np.array([far.get(i, -np.inf) for i in range(len(piv))]) + eps

    @F.pandas_udf("array<int>")
    def homes(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=object)
        away = np.sqrt(squared(np.stack(v.to_numpy()), piv))
        slack = 1e-6 * (1.0 + away)
        go = (away <= reach + slack) & (away <= away.min(1)[:, None] + 2 * eps + slack)
        return pd.Series([np.nonzero(g)[0].astype("int32").tolist() for g in go], dtype=object)

    copies = cut(right.withColumn("cell", F.explode(homes("v"))))
    parts = lambda d, name: d.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = F.broadcast(cut(parts(at, "_nx").join(parts(copies, "_ny"), "cell")))
    part = lambda n: F.pmod(F.xxhash64("vk"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = at.join(sizes, "cell").withColumn("xb", part(F.col("_nx"))).withColumn("yb", every("_ny")).drop("_nx", "_ny", "r")
    y = copies.join(sizes, "cell").withColumn("yb", part(F.col("_ny"))).withColumn("xb", every("_nx")).drop("_nx", "_ny")
    names = [f.split()[0] for f in schema.split(", ")]

    def meet(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if len(one) == 0 or len(two) == 0:
            return no_rows(*names)
        return work(one, two, near(np.stack(one["v"].to_numpy()), np.stack(two["v"].to_numpy()), eps))

    x, y = x.toDF(*x.columns), y.toDF(*y.columns)  # both sides may come from one frame
    return x.groupBy("cell", "xb", "yb").cogroup(y.groupBy("cell", "xb", "yb")).applyInPandas(meet, schema)


def weigh(one: pd.DataFrame, two: pd.DataFrame, hits: np.ndarray) -> pd.DataFrame:
    """(vk, within): the weight ``n`` of the right points near each left one."""
    a, b = np.nonzero(hits)
    total = np.zeros(len(one), dtype="int64")
    np.add.at(total, a, two["n"].to_numpy().astype("int64")[b])
    return pd.DataFrame({"vk": one["vk"], "within": total})


def lowest(one: pd.DataFrame, two: pd.DataFrame, hits: np.ndarray) -> pd.DataFrame:
    """(vk, cluster): the smallest ``cluster`` near each left point that has any."""
    a, b = np.nonzero(hits)
    best = np.full(len(one), np.iinfo("int64").max)
    np.minimum.at(best, a, two["cluster"].to_numpy().astype("int64")[b])
    found = hits.any(1)
    return pd.DataFrame({"vk": pd.Series(one["vk"].to_numpy()[found], dtype=object), "cluster": best[found]})


def forest(one: pd.DataFrame, two: pd.DataFrame, hits: np.ndarray) -> pd.DataFrame:
    """(src, dst): the components of the nodes that a block's hits link, as stars; at most a row per point."""
    nodes, code = np.unique(np.concatenate([one["node"].to_numpy(), two["node"].to_numpy()]).astype(str), return_inverse=True)
    a, b = np.nonzero(hits)
    left, right = code[:len(one)][a], code[len(one):][b]
    other = left != right
    left, right = left[other], right[other]
    head = np.arange(len(nodes))
    while True:  # each round takes the smallest head over the links, also for the heads themselves, and follows it
        low = head.copy()
        np.minimum.at(low, left, head[right])
        np.minimum.at(low, right, head[left])
        np.minimum.at(low, head, low.copy())
        low = low[low]
        if (low == head).all():
            break
        head = low
    linked = head != np.arange(len(nodes))
    return pd.DataFrame({"src": pd.Series(nodes[head[linked]], dtype=object), "dst": pd.Series(nodes[linked], dtype=object)})
