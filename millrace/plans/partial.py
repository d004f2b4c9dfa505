"""k nearest donors of rows with holes, under the distance of the coordinates that both rows have.

dist(q, s)^2 = d / |both| * sum over both of (q - s)^2, with d coordinates in all. Rows are dealt to cells by their nearest
pivot (holes filled with the mean; that only decides who is near whom) and by the pattern of holes, the common
ones each of their own. A cell keeps its box and the coordinates that all its rows have, from which follow two
bounds that hold whatever is absent:

* the coordinates that a cell always has count in full: d / |those of q| * sum of their squared gaps to the box;
* dist^2 is d times a mean of squared gaps, so at least d times the smallest one.

One search serves all patterns: a first pass meets the cells around a query, its k-th distance then rules out cells
for the second pass. The number of jobs depends neither on the patterns nor on the columns.

Where a query meets a cell, the distance depends on the shared coordinates alone, and one of them can't differ by more than
the whole: rows sorted by a shared coordinate give a bound on the k-th distance from those next to the query, and then
the stretch outside of which no donor can be. Only that stretch is compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from millrace.plans.counting import num
from millrace.plans.lineage import cut
from millrace.plans.neighbours import _distinct_vectors, no_rows, squared

BLOCK = 20_000  # queries and donors of a cell that meet at once
DENSE = 1_000   # of these, where all pairs are compared
SIDE = 32       # donors on each side of a query, by one coordinate, from which its k-th distance is bounded
PAIRS = 500_000 # pairs compared at once
PIVOTS = 256
PATTERNS = 16   # patterns with cells of their own; all others share cells, whose box bounds are weaker


def holed(cols: list[str]):
    """The columns as array<double> with NaN for a missing value and one zero."""
    return F.array(*[F.coalesce(num(c) + F.lit(0.0), F.lit(float("nan"))) for c in cols])


def digest(v) -> F.Column:
    return F.md5(F.to_json(v))


def _matrix(v: pd.Series, d: int) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(float) if len(v) else np.zeros((0, d))


def _stretches(q: np.ndarray, s: np.ndarray, most: np.ndarray, k: int):
    """(order, begin, count): ``s[order[begin:begin + count]]`` holds all rows that may be among the k nearest of a query, none
    farther than ``most`` being wanted. All coordinates are shared; of those with the most values each query takes the
    one with the shortest stretch. ``order`` has the rows once per such coordinate."""
    n, side = len(s), max(SIDE, k)
    sorts = [s[:, j].argsort(kind="stable") for j in range(s.shape[1])]
    steps = [np.count_nonzero(np.diff(s[o, j])) for j, o in enumerate(sorts)]
    chosen = sorted(range(len(sorts)), key=lambda j: -steps[j])[:4]
    most = most.copy()
    if n > 2 * side:
        for j in chosen:
            at = np.clip(np.searchsorted(s[sorts[j], j], q[:, j]) - side, 0, n - 2 * side)
            for i in range(0, len(q), DENSE):
                near = s[sorts[j][at[i:i + DENSE, None] + np.arange(2 * side)]]
                gap = ((q[i:i + DENSE, None, :] - near) ** 2).sum(2)
                most[i:i + DENSE] = np.minimum(most[i:i + DENSE], np.sqrt(np.partition(gap, k - 1, axis=1)[:, k - 1]))
    most = most * (1 + 1e-9) + 1e-9 + 1e-12 * np.abs(q).max(1)
    begin, count = np.zeros(len(q), dtype=int), np.full(len(q), n + 1)
    for i, j in enumerate(chosen):
        values = s[sorts[j], j]
        low, high = np.searchsorted(values, q[:, j] - most, "left"), np.searchsorted(values, q[:, j] + most, "right")
        fewer = high - low < count
        begin[fewer], count[fewer] = (low + i * n)[fewer], (high - low)[fewer]
    return np.concatenate([sorts[j] for j in chosen]), begin, count


def _compare(left: pd.DataFrame, right: pd.DataFrame, d: int, k: int) -> pd.DataFrame:
    """The k best donors of each query and missing coordinate, none farther than its ``t``; pattern by pattern if these are few."""
    empty = no_rows("vk", "c", "dist", "id", "x")
    if len(left) == 0 or len(right) == 0:
        return empty
    finite = lambda f: f[~np.isinf(_matrix(f["v"], d)).any(1)]  # no distance from what is infinite
    left, right = finite(left), finite(right)
    if len(left) == 0 or len(right) == 0:
        return empty
    q, s = _matrix(left["v"], d), _matrix(right["v"], d)
    vk, t = left["vk"].to_numpy(), left["t"].to_numpy(dtype=float)
    length = right["ids"].map(len).to_numpy()
    ids, start = np.concatenate(right["ids"].to_numpy()), np.cumsum(length) - length
    asked, of_q = np.unique(~np.isnan(q), axis=0, return_inverse=True)
    given, of_s = np.unique(~np.isnan(s), axis=0, return_inverse=True)
    of_q, of_s = of_q.reshape(-1), of_s.reshape(-1)
    out = []

    def dense(rows, donors):
        for i in range(0, len(rows), DENSE):
            for j in range(0, len(donors), DENSE):
                out.append(_compare_all(left.iloc[rows[i:i + DENSE]], right.iloc[donors[j:j + DENSE]], d, k))

    def best(a, b, new):
        gap = q[a] - s[b]
        dist = np.sqrt(d / (~np.isnan(gap)).sum(1) * np.nansum(gap * gap, axis=1))
        keep = dist <= t[a] * (1 + 1e-9)
        a, b, dist = a[keep], b[keep], dist[keep]
        reps = length[b]
        at = np.repeat(start[b] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
        flat = pd.DataFrame({"row": np.repeat(a, reps), "donor": np.repeat(b, reps), "dist": np.repeat(dist, reps), "id": ids[at]})
        flat = flat.sort_values(["row", "dist", "id"], kind="stable").groupby("row", sort=False).head(k)
        for c in np.flatnonzero(new):
            out.append(pd.DataFrame({"vk": vk[flat["row"]], "c": np.full(len(flat), c, dtype="int32"), "dist": flat["dist"].to_numpy(),
                                     "id": flat["id"].to_numpy(), "x": s[flat["donor"], c]}))

    if len(asked) * len(given) > PATTERNS ** 2:
        dense(np.arange(len(q)), np.arange(len(s)))
    else:
        for i, has in enumerate(asked):
            for j, gives in enumerate(given):
                both, new = has & gives, gives & ~has
                if not both.any() or not new.any():
                    continue
                rows, donors = np.flatnonzero(of_q == i), np.flatnonzero(of_s == j)
                order, begin, count = _stretches(q[np.ix_(rows, both)], s[np.ix_(donors, both)], t[rows] * np.sqrt(both.sum() / d), k)
                wide = (count > len(donors) / 4) & (len(donors) > DENSE)   # most of the donors: matrix products are faster
                if wide.any():
                    dense(rows[wide], donors)
                rows, begin, count = rows[~wide], begin[~wide], count[~wide]
                part = (np.cumsum(count) - count) // PAIRS
                for g in np.unique(part):
                    r, f, n = rows[part == g], begin[part == g], count[part == g]
                    at = np.repeat(f - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    best(np.repeat(r, n), donors[order[at]], new)
    out = [x for x in out if len(x)]
    return pd.concat(out, ignore_index=True) if out else empty


def _compare_all(left: pd.DataFrame, right: pd.DataFrame, d: int, k: int) -> pd.DataFrame:
    """The k best donors of each query and missing coordinate; matrix products only preselect."""
    empty = no_rows("vk", "c", "dist", "id", "x")
    if len(left) == 0 or len(right) == 0:
        return empty
    q, s = _matrix(left["v"], d), _matrix(right["v"], d)
    ids, vk = right["ids"].to_numpy(), left["vk"].to_numpy()
    mq, ms = ~np.isnan(q), ~np.isnan(s)
    q0, s0 = np.where(mq, q, 0.0), np.where(ms, s, 0.0)
    both = mq.astype(float) @ ms.T.astype(float)
    rough = (q0 ** 2) @ ms.T - 2.0 * (q0 @ s0.T) + mq @ (s0 ** 2).T
    rough = np.where(both > 0, np.maximum(rough, 0.0) * d / np.maximum(both, 1.0), np.inf)
    slack = 1e-9 * d * (1.0 + (q0 ** 2).sum(1).max() + (s0 ** 2).sum(1).max())
    out = []
    for c in np.nonzero(~mq.all(0))[0]:
        asks, gives = np.nonzero(~mq[:, c])[0], np.nonzero(ms[:, c])[0]
        if len(gives) == 0:
            continue
        near = rough[np.ix_(asks, gives)]
        last = np.partition(near, k - 1, axis=1)[:, k - 1] if len(gives) > k else np.full(len(asks), np.inf)
        a, b = np.nonzero(np.isfinite(near) & (near <= (last + slack)[:, None]))
        a, b = asks[a], gives[b]
        if len(a) == 0:
            continue
        dist = np.empty(len(a))
        for i in range(0, len(a), 200_000):
            j = slice(i, i + 200_000)
            gap = q[a[j]] - s[b[j]]
            dist[j] = np.sqrt(d / (~np.isnan(gap)).sum(1) * np.nansum(gap * gap, axis=1))
        reps = np.fromiter((len(ids[i]) for i in b), dtype=int, count=len(b))
        flat = pd.DataFrame({"row": np.repeat(a, reps), "dist": np.repeat(dist, reps),
                             "id": np.concatenate([np.asarray(ids[i]) for i in b]), "x": np.repeat(s[b, c], reps)})
        best = flat.sort_values(["row", "dist", "id"], kind="stable").groupby("row", sort=False).head(k)
        out.append((vk[best["row"]], np.full(len(best), c, dtype="int32"), *[best[n].to_numpy() for n in ("dist", "id", "x")]))
    return pd.DataFrame(dict(zip(empty.columns, map(np.concatenate, zip(*out))))) if out else empty


def _meet(asked: DataFrame, donors: DataFrame, d: int, k: int, block: int, id_type: str) -> DataFrame:
    """(vk, c, dist, id, x): queries (cell, vk, v, t) against the donors of their cells, block by block; none farther than ``t`` is wanted."""
    sizes = (asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nq"))
             .join(donors.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nb")), "cell"))
    sizes = F.broadcast(cut(sizes))  # at most PIVOTS * PATTERNS rows
    part = lambda n: F.pmod(F.xxhash64("vk"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = asked.join(sizes, "cell").withColumn("qb", part(F.col("_nq"))).withColumn("sb", every("_nb")).select("cell", "qb", "sb", "vk", "v", "t")
    s = donors.join(sizes, "cell").withColumn("sb", part(F.col("_nb"))).withColumn("qb", every("_nq")).select("cell", "qb", "sb", "v", "ids")
    q, s = q.toDF(*q.columns), s.toDF(*s.columns)  # both sides may come from one frame
    return q.groupBy("cell", "qb", "sb").cogroup(s.groupBy("cell", "qb", "sb")).applyInPandas(
        lambda a, b: _compare(a, b, d, k), f"vk string, c int, dist double, id {id_type}, x double")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("vk", "c").orderBy("dist", "id"))
    return found.withColumn("_i", place).filter(F.col("_i") <= k).drop("_i")


def donor_means(df: DataFrame, cols: list[str], key: str, k: int, means: list[float | None], block: int = BLOCK,
                pivots: int = PIVOTS) -> DataFrame | None:
    """(vk, x0, x1, ...): per distinct row with holes the mean of its k nearest donors in each missing column.

    ``vk`` is ``digest(holed(cols))``. Donors share a present column with the row and have the missing one; ties
    go to the smallest ``key``. Null where there is no donor, as are the columns that the row has. None without
    any row that could give or take.
    """
    d, spark = len(cols), df.sparkSession
    spread = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    some = F.exists("v", lambda x: ~F.isnan(x))
    rows = df.select(F.col(key), holed(cols).alias("v")).filter(some)
    donors = cut(_distinct_vectors(rows, key, k).withColumn("vk", digest("v")).repartition(spread, "vk"))
    asking = rows.filter(F.exists("v", F.isnan)).select("v").distinct().withColumn("vk", digest("v"))
    n = donors.count()
    if n == 0:
        return None
    fill = np.array([0.0 if m is None else float(m) for m in means])
    take = int(min(pivots, max(1, round(n ** 0.5 / 2))))
    piv = np.array([r["v"] for r in donors.orderBy("vk").select("v").limit(take).collect()], dtype=float)
    piv = np.where(np.isnan(piv), fill, piv)
    pattern = F.concat_ws("", F.transform("v", lambda x: F.when(F.isnan(x), "0").otherwise("1")))
    common = [r["m"] for r in donors.groupBy(pattern.alias("m")).count().orderBy(F.desc("count"), "m").limit(PATTERNS - 1).collect()]

    @F.pandas_udf("int")
    def pivot_of(v: pd.Series) -> pd.Series:
        x = _matrix(v, d)
        return pd.Series(squared(np.where(np.isnan(x), fill, x), piv).argmin(1).astype("int32") if len(x) else [], dtype="int32")

    rank = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in common]), pattern), F.lit(0)).cast("int")
    donors = cut(donors.withColumn("cell", pivot_of("v") * PATTERNS + rank))
    at = lambda i: F.when(~F.isnan(F.col("v")[i]), F.col("v")[i])
    facts = donors.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[f(at(i)).alias(f"{name}{i}") for i in range(d) for f, name in (
        (F.min, "lo"), (F.max, "hi"), (F.count, "have"))]).orderBy("cell").collect()  # at most pivots * PATTERNS rows
    table = lambda name: np.array([[np.nan if r[f"{name}{i}"] is None else r[f"{name}{i}"] for i in range(d)] for r in facts], dtype=float)
    lo, hi, have = table("lo"), table("hi"), table("have")
    always, ever = have == np.array([r["n"] for r in facts])[:, None], have > 0
    cells = np.array([r["cell"] for r in facts], dtype="int32")
    home = cells // PATTERNS
    by_pivot = np.zeros((len(piv), d))
    np.add.at(by_pivot, home, have)

    def around(x: np.ndarray) -> list[np.ndarray]:
        """Per query a mask of the cells around it that hold k donors of each missing column, if so many exist."""
        order = squared(np.where(np.isnan(x), fill, x), piv).argsort(1, kind="stable")
        out = []
        for row, o in zip(x, order):
            enough = (by_pivot[o].cumsum(0)[:, np.isnan(row)] >= k).all(1)
            first = int(enough.argmax()) if enough.any() else len(o) - 1
            out.append(np.isin(home, o[:first + 1]) & ever[:, np.isnan(row)].any(1))
        return out

    @F.pandas_udf("array<int>")
    def first_cells(v: pd.Series) -> pd.Series:
        return pd.Series([cells[m].tolist() for m in around(_matrix(v, d))], dtype=object)

    @F.pandas_udf("array<int>")
    def other_cells(v: pd.Series, theta: pd.Series) -> pd.Series:
        x, out = _matrix(v, d), []
        for row, seen, limit in zip(x, around(x), theta.to_numpy()):
            has = ~np.isnan(row)
            gap = np.maximum(np.maximum(lo[:, has] - row[has], row[has] - hi[:, has]), 0.0) ** 2
            full = np.where(always[:, has], gap, 0.0).sum(1) * d / has.sum()
            least = np.where(ever[:, has], gap, np.inf).min(1) * d  # infinite where nothing is shared
            low = np.sqrt(np.maximum(full, least))
            go = ~seen & np.isfinite(low) & (low <= limit * (1 + 1e-9) + 1e-9) & ever[:, ~has].any(1)
            out.append(cells[go].tolist())
        return pd.Series(out, dtype=object)

    id_type = dict(df.dtypes)[key]
    asking = cut(asking.repartition(spread, "vk"))
    one = cut(asking.withColumn("cell", F.explode(first_cells("v"))).withColumn("t", F.lit(float("inf"))))
    near = cut(_best(_meet(one, donors, d, k, block, id_type), k))
    last = near.groupBy("vk", "c").agg(F.count(F.lit(1)).alias("m"), F.max("dist").alias("t")).filter(F.col("m") >= k)
    reach = last.groupBy("vk").agg(F.count(F.lit(1)).alias("known"), F.max("t").alias("t"))
    holes = F.size(F.filter("v", F.isnan))
    theta = F.when(F.col("known") == holes, F.col("t")).otherwise(F.lit(float("inf")))
    bounded = asking.join(reach, "vk", "left").select("vk", "v", theta.alias("t")).repartition(spread, "vk")
    two = cut(bounded.select("vk", "v", "t", F.explode(other_cells("v", "t")).alias("cell")))
    best = _best(near.unionByName(_meet(two, donors, d, k, block, id_type)), k)
    return best.groupBy("vk").agg(*[F.avg(F.when(F.col("c") == i, F.col("x"))).alias(f"x{i}") for i in range(d)])
