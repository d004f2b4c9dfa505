"""Exact k nearest neighbours with pivot cells (Lu et al., "Efficient processing of k nearest neighbor
joins using MapReduce", 2012).

Equal vectors are folded into one, with the smallest ids kept: k + 1 of them suffice for any answer. Points are dealt to
the cells of pivots, large cells to parts. A query meets its own part first, which bounds its k-th distance; the triangle
inequality and the planes between pivots then say which other parts can hold a neighbour. Where these are few, the
query is copied to them. Where they are many (vectors of many columns), copies would grow with the square of the points:
blocks are saved once instead, and every task holds one block of queries while it reads the blocks of points, so
nothing is copied on disk. In both cases a task keeps the k best per query while it compares, and no pair list is built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.plans.counting import num
from millrace.plans.lineage import cut, saved_blocks
from millrace.plans.lookup import fit_lookup, join_lookup

BLOCK = 16_384           # queries and points that meet at once
BLOCK_BYTES = 16 << 20   # of the vectors of a block that is read again and again
CELLS = 2_048            # pivots of ``nearest``; up to 16 million vectors, cells grow with the root of their number
PAIRS = 4_000_000        # compared at once
COPIES = 8               # parts that a query is copied to, on average, before all blocks meet all blocks
PIVOTS = 256             # of ``plans/balls.py``


def vector(cols: list[str] | str) -> Column:
    """Columns (or one array column) as array<double>; any null or NaN makes the vector null."""
    if isinstance(cols, str):
        v = F.col(cols).cast("array<double>")
        return F.when(~F.exists(v, lambda x: x.isNull() | F.isnan(x)), v)
    values = F.array(*[num(c) for c in cols])
    return F.when(F.size(F.array_compact(values)) == len(cols), values)


def no_rows(*names: str) -> pd.DataFrame:
    """An empty result of any types; pandas takes untyped empty columns for numbers, which are no strings to Arrow."""
    return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


class Closest:
    """The k nearest of a block of queries among the points offered so far, by distance, then id.

    ``limit`` is what is known of a query's k-th distance beforehand; farther points are left out. The fast matrix product
    only preselects; the distances of the preselected pairs are computed from differences.
    """

    def __init__(self, q: np.ndarray, k: int, limit: np.ndarray):
        self.q, self.k, self.limit = q, k, limit.astype(float)
        finite = q[np.isfinite(q).all(1)]
        self.centre = finite.mean(0) if len(finite) else np.zeros(q.shape[1])   # the product is exact to the distance from it
        moved = q - self.centre
        self.q2 = (moved * moved).sum(1)
        self.product = np.column_stack([-2.0 * moved, np.ones(len(q))])
        self.row, self.dist, self.ids = np.empty(0, dtype=int), np.empty(0), None

    def offer(self, s: np.ndarray, first: np.ndarray, ids: np.ndarray, tight: bool = True) -> None:
        """Point j has the ids from ``first[j]`` to ``first[j + 1]``. Unless ``tight``, this block's own k-th distances
        lower the limits first."""
        if len(s) == 0 or len(self.q) == 0:
            return
        moved = s - self.centre
        s2 = (moved * moved).sum(1)
        across = np.column_stack([moved, s2]).T
        slack = 1e-14 * (s.shape[1] + 8) * (self.q2 + np.fmax.reduce(s2))
        step, found = max(PAIRS // len(s), 1), []
        for i in range(0, len(self.q), step):
            part = self.product[i:i + step] @ across
            most = self.limit[i:i + step] ** 2 - self.q2[i:i + step]
            if not tight and len(s) > self.k:
                most = np.fmin(most, np.partition(part, self.k - 1, axis=1)[:, self.k - 1])
            hit = np.flatnonzero(part <= (most + slack[i:i + step])[:, None])
            if len(hit):
                found.append(self._exact(hit // len(s) + i, hit % len(s), s, first, ids))
        if found:
            row, col, dist = [np.concatenate(x) for x in zip(*found)]
            many = (first[1:] - first[:-1])[col]
            place = np.repeat(first[col], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            self._keep(np.repeat(row, many), np.repeat(dist, many), ids[place])

    def _exact(self, row: np.ndarray, col: np.ndarray, s: np.ndarray, first: np.ndarray, ids: np.ndarray):
        """The preselected pairs within the limits. Where they are many, as the product could not tell them apart, the k best
        points of each query, by distance and smallest id, hold its k best ids."""
        dist = np.empty(len(row))
        for i in range(0, len(row), 200_000):
            j = slice(i, i + 200_000)
            dist[j] = np.sqrt(((self.q[row[j]] - s[col[j]]) ** 2).sum(1))
        near = dist <= self.limit[row]
        row, col, dist = row[near], col[near], dist[near]
        if len(row) > 8 * self.k * len(np.unique(row)):
            order = np.lexsort((_codes(ids[first[col]]), dist, row))
            ordered = row[order]
            order = order[np.arange(len(row)) - np.searchsorted(ordered, ordered) < self.k]
            row, col, dist = row[order], col[order], dist[order]
        return row, col, dist

    def _keep(self, row: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        row, dist = np.concatenate([self.row, row]), np.concatenate([self.dist, dist])
        ids = ids if self.ids is None else np.concatenate([self.ids, ids])
        order = np.lexsort((_codes(ids), dist, row))
        row = row[order]
        start = np.searchsorted(row, np.arange(len(self.q)))
        best = np.arange(len(row)) - start[row] < self.k
        order = order[best]
        self.row, self.dist, self.ids = row[best], dist[order], ids[order]
        end = np.searchsorted(self.row, np.arange(1, len(self.q) + 1))
        full = np.flatnonzero(end - np.concatenate([[0], end[:-1]]) == self.k)
        self.limit[full] = np.minimum(self.limit[full], self.dist[end[full] - 1])

    def lists(self, id_type: pa.DataType) -> list[pa.Array]:
        """The distances and the ids, a list of each per query."""
        ends = np.concatenate([[0], np.cumsum(np.bincount(self.row, minlength=len(self.q)))]).astype("int32")
        values = [pa.array(self.dist, pa.float64()), pa.array([] if self.ids is None else self.ids, id_type)]
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x, type=_list(x.type)) for x in values]


def _codes(ids: np.ndarray) -> np.ndarray:
    """Ids of any type as what sorts like them."""
    return np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids


def _list(kind: pa.DataType) -> pa.DataType:
    return pa.list_(pa.field("element", kind))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    widths = pc.list_value_length(column).to_numpy()
    if len(widths) and (widths != widths[0]).any():
        raise ValueError("all vectors must have the same length")
    flat = pc.list_flatten(column).to_numpy()
    return flat.reshape(len(widths), widths[0] if len(widths) else 0)


def _points(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``Closest.offer`` takes, of a table with ``v`` and ``ids``."""
    ends = np.cumsum(pc.list_value_length(table["ids"]).to_numpy())
    return _matrix(table["v"]), np.concatenate([[0], ends]).astype(int), pc.list_flatten(table["ids"]).to_numpy()


def _assign(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``cell`` and ``r``: the nearest pivot and the distance to it."""
    @F.pandas_udf("cell int, r double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        if len(v) == 0:
            return pd.DataFrame({"cell": pd.Series([], dtype="int32"), "r": pd.Series([], dtype="float64")})
        x = np.stack(v.to_numpy())
        step = max(2_000_000 // len(pivots), 1)
        cell = np.concatenate([squared(x[i:i + step], pivots).argmin(1) for i in range(0, len(x), step)])
        return pd.DataFrame({"cell": cell.astype("int32"), "r": np.sqrt(((x - pivots[cell]) ** 2).sum(1))})

    return df.withColumn("_n", nearest("v")).select("*", "_n.cell", "_n.r").drop("_n")


def _distinct_vectors(df: DataFrame, key: str, keep: int) -> DataFrame:
    """(vk, v, ids): equal vectors folded, the ``keep`` smallest ids each (bounded at every step)."""
    salted = (df.select(F.col("v"), F.col(key).alias("id"), F.pmod(F.xxhash64(key), F.lit(64)).alias("salt")))
    place = F.row_number().over(W.partitionBy("v", "salt").orderBy("id"))
    few = salted.withColumn("_i", place).filter(F.col("_i") <= keep)
    ids = F.slice(F.sort_array(F.collect_list("id")), 1, keep)  # at most 64 * keep ids before the slice
    return few.groupBy("v").agg(ids.alias("ids")).withColumn("vk", F.md5(F.to_json("v")))


def _blocks(sizes: dict[int, int], block: int) -> dict[int, int]:
    return {c: max(-(-n // block), 1) for c, n in sizes.items()}


def _lut(values: dict[int, int], cell: Column, default: int = 1) -> Column:
    """Small per-cell number as an array look-up."""
    size = max(values, default=0) + 1
    return F.coalesce(F.get(F.array(*[F.lit(int(values.get(i, default))) for i in range(size)]), cell), F.lit(default))


class _Cells:
    """Pivots, and of each cell: the distances from the pivot to its nearest and farthest point, a bound on the k-th distance
    from the pivot, and the number of its parts and that of its first part."""

    def __init__(self, pivots: np.ndarray, near: dict[int, list[float]], far: dict[int, float], sizes: dict[int, int], want: int, block: int):
        m = len(pivots)
        self.pivots = pivots
        self.low = np.array([min(near[j]) if j in near else np.inf for j in range(m)])
        self.high = np.array([far.get(j, -np.inf) for j in range(m)])
        self.parts = np.array([-(-sizes.get(j, 0) // block) for j in range(m)], dtype=int)
        self.first = np.cumsum(self.parts) - self.parts
        own = np.concatenate([[], *[np.full(len(rs), j) for j, rs in near.items()]]).astype(int)
        rs = np.concatenate([[], *near.values()])
        self.kth = np.full(m, np.inf)
        if len(rs) >= want:
            for j in range(m):
                self.kth[j] = np.partition(np.sqrt(((pivots - pivots[j]) ** 2).sum(1))[own] + rs, want - 1)[want - 1]
        self.size = np.sqrt((pivots * pivots).sum(1)) + np.maximum(self.high, 0.0)   # no point of the cell is longer

    def reached(self, x: np.ndarray, cell: int, t: np.ndarray) -> Iterator[np.ndarray]:
        """For queries of one cell, some at a time, the boolean matrix of the cells that may hold a point within ``t``.

        A point of cell j lies on j's side of the plane between both pivots, and between j's nearest and farthest
        point from its pivot. The slack covers what the rounding of ``squared`` can do, here and where points were dealt.
        """
        gap = np.sqrt(((self.pivots - self.pivots[cell]) ** 2).sum(1))
        step = max(1_000_000 // len(self.pivots), 1)
        for i in range(0, len(x), step):
            q, most = x[i:i + step], t[i:i + step]
            hits = np.zeros((len(q), len(self.pivots)), dtype=bool)
            far = (np.sqrt(((q - self.pivots[cell]) ** 2).sum(1)) + most).max()
            some = np.flatnonzero((self.parts > 0) & ~(gap - self.high > far + 1e-9 * (gap + far + np.abs(self.high))))
            d2 = squared(q, self.pivots[some])
            own = ((q - self.pivots[cell]) ** 2).sum(1)[:, None]
            err = 1e-14 * (q.shape[1] + 4) * ((q * q).sum(1)[:, None] + self.size[some] ** 2 + self.size[cell] ** 2)
            away, blur = np.sqrt(d2), np.sqrt(err)
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (d2 - own - err) / (2.0 * gap[some])
            low = np.maximum(np.fmax(plane, 0.0), np.maximum(self.low[some] - away, away - self.high[some]) - blur)
            hits[:, some] = ~(low > (most * (1.0 + 1e-9))[:, None])
            yield hits


def _meet(q: DataFrame, s: DataFrame, sizes: dict[int, int], block: int, work, schema: str) -> DataFrame:
    """``work(queries, points)`` for each ``part``; where a part has many queries, they are dealt over copies of its points."""
    slices = _lut({c: -(-n // block) for c, n in sizes.items()}, F.col("part"))
    q = q.withColumn("slice", F.pmod(F.xxhash64("vk", F.lit(1)), slices).cast("int"))
    s = s.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).select("part", "slice", "v", "ids")
    cores, keys = q.sparkSession.sparkContext.defaultParallelism, sum(-(-n // block) for n in sizes.values())
    tasks = max(min(keys, max(2 * cores, keys // 8)), 1)   # by work: the rows are few bytes
    q, s = [d.toDF(*d.columns).repartition(tasks, "part", "slice") for d in (q, s)]   # both sides may come from one frame
    return q.groupBy("part", "slice").cogroup(s.groupBy("part", "slice")).applyInArrow(work, schema)


def _all_meet(q: DataFrame, s: DataFrame, want: int, block: int, out: str) -> DataFrame:
    """(vk, n, dist, id) of queries (vk, v, n, t): every block of queries meets every block of points.

    Both are saved once. A task holds one block of queries and reads the blocks of a stretch of the points one after the
    other, so it writes only the k best of its queries.
    """
    cores = q.sparkSession.sparkContext.defaultParallelism
    n_q, n_s = q.count(), s.count()
    q_blocks, s_blocks = [max(-(-n // block), min(cores, -(-n // 256))) for n in (n_q, n_s)]
    left, right = saved_blocks(q, q_blocks), saved_blocks(s.select("vk", "v", "ids"), s_blocks).coalesce(min(s_blocks, -(-3 * cores // q_blocks)))

    def search(pairs):
        held, table, best, kind = None, None, None, None

        def result():
            return (_ipc(pa.table([table["vk"], table["n"], *best.lists(kind)], names=["vk", "n", "dist", "id"])),)

        for one, two in pairs:
            if one["block"] != held:
                if best is not None:
                    yield result()
                held, table = one["block"], _table(one["data"])
                best = Closest(_matrix(table["v"]), want, table["t"].to_numpy())
            points = _table(two["data"])
            kind = points["ids"].type.value_type
            best.offer(*_points(points))
        if best is not None:
            yield result()

    def rows(batches):
        for batch in batches:
            for data in batch.column("data"):
                yield from _table(data.as_buffer()).to_batches()

    found = q.sparkSession.createDataFrame(left.cartesian(right).mapPartitions(search), "data binary", verifySchema=False)
    return _merged(found.mapInArrow(rows, out), want) if right.getNumPartitions() > 1 else found.mapInArrow(rows, out)


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(data) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def _merged(found: DataFrame, want: int) -> DataFrame:
    """(vk, n, dist, id): the ``want`` best of a query's lists."""
    lists = F.collect_list(F.arrays_zip("dist", "id"))
    best = found.groupBy("vk").agg(F.max("n").alias("n"), F.slice(F.sort_array(F.flatten(lists)), 1, want).alias("_f"))
    return best.select("vk", "n", F.col("_f.dist").alias("dist"), F.col("_f.id").alias("id"))


def nearest(queries: DataFrame, points: DataFrame, k: int, query_key: str, point_key: str,
            exclude_same: bool = False, block: int = BLOCK, pivots: int = CELLS) -> DataFrame:
    """(query_key, neighbours): the k nearest points as array<struct<dist, id>>, by distance then id.

    Both frames carry ``v`` array<double>; null vectors are left out. ``exclude_same`` drops the point whose
    id equals the query's.
    """
    want = k + 1 if exclude_same else k
    one_zero = F.transform("v", lambda x: x + F.lit(0.0))  # grouping takes -0.0 for 0.0, the digest would not
    queries, points = [d.filter("v is not null").withColumn("v", one_zero) for d in (queries, points)]
    id_type = dict(points.dtypes)[point_key]
    s = cut(_distinct_vectors(points, point_key, want))
    n_points = s.count()
    if n_points == 0:
        return queries.select(query_key).limit(0).withColumn("neighbours", F.array().cast(f"array<struct<dist:double,id:{id_type}>>"))
    m = int(min(pivots, max(1, round(n_points ** 0.5 / 2))))
    piv = np.array([r["v"] for r in s.orderBy("vk").select("v").limit(m).collect()], dtype=float)
    folded = queries.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("vk", F.md5(F.to_json("v")))
    s, q = cut(_assign(s.filter(F.size("ids") > 0), piv)), cut(_assign(folded, piv))

    # per-cell facts: at most `pivots` rows of them
    ranked = s.select("cell", "r").withColumn("_i", F.row_number().over(W.partitionBy("cell").orderBy("r"))).filter(F.col("_i") <= want)
    near = {r["cell"]: r["rs"] for r in ranked.groupBy("cell").agg(F.collect_list("r").alias("rs")).collect()}
    facts = {r["cell"]: (r["u"], r["n"]) for r in s.groupBy("cell").agg(F.max("r").alias("u"), F.count(F.lit(1)).alias("n")).collect()}
    cells = _Cells(piv, near, {c: u for c, (u, _) in facts.items()}, {c: n for c, (_, n) in facts.items()}, want, block)
    lut = lambda values: _lut(dict(enumerate(values.tolist())), F.col("cell"))
    part = (lut(cells.first) + F.pmod(F.xxhash64("vk"), F.greatest(lut(cells.parts), F.lit(1)))).cast("int")
    s, q = s.withColumn("part", part).select("part", "vk", "v", "ids"), q.withColumn("part", part)
    count = lambda d: {r["part"]: r["count"] for r in d.groupBy("part").count().collect()}
    found_types = f"dist array<double>, id array<{id_type}>"

    def at_home(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["vk", "v", "n", "cell", "part", "t", "reach", "dist", "id"]
        x, cell = _matrix(left["v"]), left["cell"].to_numpy()
        best = Closest(x, want, (left["r"].to_numpy() + cells.kth[cell]) * (1.0 + 1e-9))
        if right.num_rows:
            best.offer(*_points(right), tight=False)
        reach = np.zeros(len(x), dtype="int64")
        for c in np.unique(cell):
            rows = np.flatnonzero(cell == c)
            hits = [h[:, np.arange(len(cells.parts)) != c] @ cells.parts[np.arange(len(cells.parts)) != c] for h in cells.reached(x[rows], c, best.limit[rows])]
            reach[rows] = np.concatenate(hits) + max(cells.parts[c] - 1, 0)
        return pa.table([left["vk"], left["v"], left["n"], left["cell"], left["part"], pa.array(best.limit, pa.float64()), pa.array(reach, pa.int64()),
                         *best.lists(right["ids"].type.value_type)], names=names)

    home = cut(_meet(q.select("vk", "v", "n", "cell", "part", "r"), s, count(q), block, at_home,
                     f"vk string, v array<double>, n long, cell int, part int, t double, reach long, {found_types}"))
    n_queries, reach = home.agg(F.count(F.lit(1)), F.sum("reach")).first()
    names = ["vk", "n", "dist", "id"]
    if not reach:
        best = home.select(*names)
    elif reach > n_queries * min(COPIES, (int(cells.parts.sum()) - 1) / 2):
        # the bounds rule out too little
        few = min(block, max(BLOCK_BYTES // (8 * piv.shape[1] + 1), 1))
        best = _all_meet(home.select("vk", "v", "n", "t"), s, want, few, f"vk string, n long, {found_types}")
    else:
        @F.pandas_udf("array<int>")
        def goes_to(v: pd.Series, cell: pd.Series, part: pd.Series, t: pd.Series) -> pd.Series:
            out, x, c = [None] * len(v), np.stack(v.to_numpy()) if len(v) else None, cell.to_numpy()
            for one in np.unique(c):
                rows = np.flatnonzero(c == one)
                masks = np.concatenate(list(cells.reached(x[rows], one, t.to_numpy()[rows])))
                masks[:, one] = cells.parts[one] > 0
                for i, mask in zip(rows, masks):
                    to = np.concatenate([np.arange(cells.first[j], cells.first[j] + cells.parts[j]) for j in np.flatnonzero(mask)])
                    out[i] = to[to != part.iloc[i]].astype("int32")
            return pd.Series(out, dtype=object)

        def abroad(left: pa.Table, right: pa.Table) -> pa.Table:
            best = Closest(_matrix(left["v"]), want, left["t"].to_numpy())
            if left.num_rows and right.num_rows:
                best.offer(*_points(right))
            some = pa.array(np.isin(np.arange(left.num_rows), best.row))
            return pa.table([left["vk"], left["n"], *best.lists(right["ids"].type.value_type)], names=["vk", "n", "dist", "id"]).filter(some)

        sent = cut(home.filter("reach > 0").withColumn("part", F.explode(goes_to("v", "cell", "part", "t"))).select("part", "vk", "v", "n", "t"))
        more = _meet(sent, s, count(sent), block, abroad, f"vk string, n long, {found_types}")
        best = home.filter("reach = 0").select(*names).unionByName(_merged(home.filter("reach > 0").select(*names).unionByName(more), want))
    best = best.toDF("vk", "n", "_dist_found", "_id_found")
    keyed = queries.select(F.col(query_key), F.md5(F.to_json("v")).alias("vk"))
    out = join_lookup(keyed, fit_lookup(best, ["vk"]), ["_dist_found", "_id_found"])
    pairs = F.zip_with("_dist_found", "_id_found", lambda d, i: F.struct(d.alias("dist"), i.alias("id")))
    found = F.when(F.size("_id_found") > 0, pairs)
    if exclude_same:
        found = F.filter(found, lambda x: x["id"] != F.col(query_key))
    return out.select(query_key, F.slice(found, 1, k).alias("neighbours"))
