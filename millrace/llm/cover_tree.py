"""Hard negatives by inner product: exact search in cover trees over norm-augmented candidates.

With one more coordinate sqrt(M^2 - |x|^2) all candidates have norm M, and for a query q (new coordinate 0)
2 q.x = |q|^2 + M^2 - d(q, x)^2: what is near has a high inner product. A node of a tree covers its rows within a radius r of its
centre c, so their products lie between (|q|^2 + M^2 - (d(q,c) + r)^2) / 2 and (|q|^2 + M^2 - (d(q,c) - r)^2) / 2. Children
are centres chosen farthest first until they cover the node's rows within half of its radius (or are ``FAN_OUT``); radii are
those measured, so the bounds hold in any case. The descent goes level by level and leaves out nodes outside of a
query's windows; what is left is opened best first and verified with whole numbers, until no open node can do better.

Spark deals the candidates by label to blocks of ``BLOCK_ROWS`` rows, builds one tree per block, and brings blocks
and blocks of anchors together by a shuffle; a task passes on the few best rows per anchor and window.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.llm.shared import returning, stored

BLOCK_ROWS, ANCHOR_ROWS = 8_192, 2_048
FAN_OUT, LEAF_ROWS = 64, 256
SCALE = 256
TREE = ("block long, ids binary, labels binary, vectors binary, centre binary, radius binary, parent binary, level binary, first binary, "
        "last binary, least binary, most binary, n long, width int, norm double, kinds array<long>")


# --- one tree ----------------------------------------------------------------------------------------------------

@dataclass
class Tree:
    """Rows in tree order: a node's rows are ``first`` to ``last``; nodes in order of level, the root first."""
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray    # whole numbers, as double
    centre: np.ndarray     # the row that is a node's centre
    radius: np.ndarray
    parent: np.ndarray
    level: np.ndarray
    first: np.ndarray
    last: np.ndarray
    least: np.ndarray      # smallest and largest label of a node's rows
    most: np.ndarray
    norm: float            # M squared


def _distances(points: np.ndarray, squares: np.ndarray, at: int) -> np.ndarray:
    return np.sqrt(np.maximum(squares + squares[at] - 2 * (points @ points[at]), 0))


def build(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS, fan_out: int = FAN_OUT) -> Tree:
    """The tree of one block."""
    plain = (vectors * vectors).sum(1)
    norm = float(plain.max())
    points = np.concatenate([vectors, np.sqrt(norm - plain)[:, None]], axis=1)
    squares = (points * points).sum(1)
    rows = np.arange(len(ids))
    nodes = []   # (level, parent, centre, radius, rows)
    root = _distances(points, squares, 0)
    level = [(-1, 0, float(root.max()), rows, root)]
    depth = 0
    while level:
        below = []
        for parent, centre, radius, own, away in level:
            number = len(nodes)
            nodes.append((depth, parent, centre, radius, own))
            if len(own) <= leaf_rows or radius == 0:
                continue
            # centres farthest first; a node's own centre is its first child's
            x, sq = points[own], squares[own]
            near, of, centres = away.copy(), np.zeros(len(own), np.int64), [centre]
            while len(centres) < fan_out and near.max() > radius / 2:
                far = int(near.argmax())
                d = _distances(x, sq, far)
                closer = d < near
                near[closer], of[closer] = d[closer], len(centres)
                centres.append(int(own[far]))
            if len(centres) == 1:   # all within half of the radius: the next level has the same centre
                below.append((number, centre, float(near.max()), own, near))
                continue
            for k, c in enumerate(centres):
                inside = of == k
                if inside.any():
                    below.append((number, c, float(near[inside].max()), own[inside], near[inside]))
        level, depth = below, depth + 1
    inner = {p for _, p, *_ in nodes}
    # rows in order of the leaves, depth first, so that each node's rows are one run
    children: dict[int, list[int]] = {}
    for k, (_, p, *_) in enumerate(nodes):
        children.setdefault(p, []).append(k)
    order, first, last = [], np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
    at, stack = 0, [(0, False)]
    while stack:
        k, done = stack.pop()
        if done:
            last[k] = at
            continue
        first[k] = at
        if k in inner:
            stack.append((k, True))
            stack += [(c, False) for c in reversed(children[k])]
        else:
            order.append(nodes[k][4])
            at += len(nodes[k][4])
            last[k] = at
    order = np.concatenate(order)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    labels = labels[order]
    least = np.array([labels[a:b].min() for a, b in zip(first, last)])
    most = np.array([labels[a:b].max() for a, b in zip(first, last)])
    return Tree(ids[order], labels, vectors[order], back[np.array([n[2] for n in nodes])], np.array([n[3] for n in nodes]),
                np.array([n[1] for n in nodes]), np.array([n[0] for n in nodes]), first, last, least, most, norm)


def open_leaves(tree: Tree, queries: np.ndarray, skip, low: np.ndarray, high: np.ndarray):
    """Level by level: per query the leaves that may hold a product from ``low`` to ``high``, with upper bounds, best first.
    ``skip(node)`` says which queries a node's labels rule out."""
    width = max(queries.shape[1], tree.vectors.shape[1])
    q2 = (queries * queries).sum(1)
    slack = 1e-9 * (q2 + tree.norm) + 1e-6
    inner = set(tree.parent.tolist())
    kids: dict[int, list[int]] = {}
    for k, p in enumerate(tree.parent.tolist()):
        kids.setdefault(p, []).append(k)
    n = len(queries)
    frontier = {0: (np.arange(n), np.full(n, np.inf), np.full(n, -np.inf))}
    leaves = []
    while frontier:
        below = {}
        for node, (who, upper, lower) in frontier.items():
            d = np.sqrt(np.maximum(q2[who] + tree.norm - 2 * (padded(queries[who], width) @ padded(tree.vectors[tree.centre[node]][None], width)[0]), 0))
            r = tree.radius[node]
            up = np.minimum(upper, (q2[who] + tree.norm - np.maximum(d - r, 0) ** 2) / 2 + slack[who])
            lo = np.maximum(lower, (q2[who] + tree.norm - (d + r) ** 2) / 2 - slack[who])
            stay = (up >= low[who]) & (lo <= high[who]) & ~skip(node)[who]
            if not stay.any():
                continue
            who, up, lo = who[stay], up[stay], lo[stay]
            if node in inner:
                for c in kids[node]:
                    below[c] = (who, up, lo)
            else:
                leaves.append((node, who, up))
        frontier = below
    found: list[list[tuple[float, int]]] = [[] for _ in range(n)]
    for node, who, up in leaves:
        for w, u in zip(who.tolist(), up.tolist()):
            found[w].append((-u, node))
    return found


def padded(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.concatenate([x, np.zeros((len(x), width - x.shape[1]))], axis=1)


def best_in_windows(tree: Tree, query: np.ndarray, leaves: list[tuple[float, int]], allowed, low: np.ndarray, high: np.ndarray, k: int):
    """Per window the first ``k`` allowed rows (product descending, then id) with a product from ``low`` to ``high``: leaves best
    first, in growing groups, until the best one left is below all that the windows still lack."""
    kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in low]
    need = low.astype(np.float64)
    heapq.heapify(leaves)
    group = 2
    while leaves and -leaves[0][0] >= need.min():
        opened = []
        while leaves and len(opened) < group and -leaves[0][0] >= need.min():
            opened.append(heapq.heappop(leaves)[1])
        group *= 2
        rows = np.concatenate([np.arange(tree.first[x], tree.last[x]) for x in opened])
        score = np.rint(tree.vectors[rows] @ query).astype(np.int64)
        fits = allowed(rows) & (score >= need.min()) & (score <= high.max())
        rows, score = rows[fits], score[fits]
        for j in range(len(low)):
            some = (score >= need[j]) & (score <= high[j])
            if not some.any():
                continue
            ids, s = np.concatenate([kept[j][0], tree.ids[rows[some]]]), np.concatenate([kept[j][1], score[some]])
            if len(s) > k:
                edge = np.partition(s, len(s) - k)[len(s) - k]
                near = s >= edge
                ids, s = ids[near], s[near]
            first = np.lexsort((ids, -s))[:k]
            kept[j] = ids[first], s[first]
            if len(first) == k:
                need[j] = s[first[-1]]   # an equal product with a smaller id still comes in
    return kept


# --- Spark jobs --------------------------------------------------------------------------------------------------

def whole_vectors(rows: DataFrame, id_col: str, vector: str, label: str, noise: Column | None = None) -> DataFrame:
    """(id, label, v): one row per id with components floor(256 x). Rows with a null id, label or vector or with a null or non-finite
    component take no part; of rows with the same id the one with the smallest label, then vector, does."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = rows.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & x.isNotNull()).filter(~bad)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("double"))
    named = F.col(label).cast("long") if noise is None else noise.cast("long")
    out = good.select(F.col(id_col).cast("long").alias("id"), named.alias("label"), whole.alias("v"))
    return out.groupBy("id").agg(F.min(F.struct("label", "v")).alias("m")).select("id", "m.label", "m.v")


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of doubles as rows; shorter ones end in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max()) if len(lengths) else 0
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def cover_trees(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block of candidates (id, label, v): its tree. Blocks hold rows of neighbouring labels."""
    n = rows.count()
    parts = max(1, -(-n // block_rows))

    def work(batches):
        from pyspark import TaskContext

        held, size, block = [], 0, TaskContext.get().partitionId() << 32

        def tree_of(table):
            nonlocal block
            columns = [table.column(c).combine_chunks() for c in ("id", "label", "v")]
            t = build(columns[0].to_numpy(zero_copy_only=False), columns[1].to_numpy(zero_copy_only=False), _matrix(columns[2]).astype(np.float64))
            arrays = [t.ids, t.labels, t.vectors, t.centre, t.radius, t.parent, t.level, t.first, t.last, t.least, t.most]
            row = [block, *[np.ascontiguousarray(a).tobytes() for a in arrays], len(t.ids), t.vectors.shape[1], t.norm, np.unique(t.labels).tolist()]
            block += 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, kinds)], names=[f.name for f in kinds])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            while size >= 2 * block_rows:
                table = pa.Table.from_batches(held)
                yield tree_of(table.slice(0, block_rows))
                held, size = table.slice(block_rows).to_batches(), size - block_rows
        if size:
            yield tree_of(pa.Table.from_batches(held))

    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    kinds = [pa.field(*[f.split(" ")[0], types[f.split(" ")[1]]]) for f in TREE.split(", ")]
    dealt = rows.repartitionByRange(parts, "label", "id").sortWithinPartitions("label", "id")
    return stored(dealt.mapInArrow(returning(work), TREE), "cover-trees")


def _read_tree(row: dict) -> Tree:
    whole, real = np.int64, np.float64
    get = lambda c, t: np.frombuffer(row[c], t)
    return Tree(get("ids", whole), get("labels", whole), get("vectors", real).reshape(row["n"], row["width"]), get("centre", whole), get("radius", real),
                get("parent", whole), get("level", whole), get("first", whole), get("last", whole), get("least", whole), get("most", whole), row["norm"])


def _searched(trees: DataFrame, anchors: DataFrame, same_label: bool, k: int) -> DataFrame:
    """(anchor_id, window, id, score): the first k rows per anchor and window of every block.

    ``anchors``: id, label, v and the arrays low and high (one window each). Same label: the blocks that hold the anchor's label."""
    chunks = max(1, -(-anchors.count() // ANCHOR_ROWS))
    asked = anchors.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))
    places = trees.select((F.col("block") + 0).alias("block"), "kinds")   # a column of its own, as trees is met again below
    if same_label:
        asked = asked.join(places.select("block", F.explode("kinds").alias("label")), "label")
    else:
        blocks = [r[0] for r in places.select("block").collect()]   # one number per block of 8192 rows
        asked = asked.withColumn("block", F.explode(F.array(*[F.lit(b).cast("long") for b in blocks]))) if len(blocks) <= 1000 else \
            asked.withColumn("block", F.explode(F.from_json(F.lit(str(blocks)), "array<long>")))
    held = trees.drop("kinds").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))

    def work(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"anchor_id": [], "window": [], "id": [], "score": []}
        if left.num_rows and right.num_rows:
            tree = _read_tree(left.to_pylist()[0])
            column = lambda c: right.column(c).combine_chunks()
            ids, labels = column("id").to_numpy(), column("label").to_numpy()
            queries = _matrix(column("v")).astype(np.float64)
            lows, highs = column("low").to_pylist(), column("high").to_pylist()
            width = max(queries.shape[1], tree.vectors.shape[1])
            queries, tree.vectors = padded(queries, width), padded(tree.vectors, width)
            if same_label:
                skip = lambda node: (labels < tree.least[node]) | (labels > tree.most[node])
            else:
                skip = lambda node: (labels == tree.least[node]) & (labels == tree.most[node])
            wide = np.array([min(x) if x else np.inf for x in lows]), np.array([max(x) if x else -np.inf for x in highs])
            for i, leaves in enumerate(open_leaves(tree, queries, skip, *wide)):
                if not leaves:
                    continue
                if same_label:
                    allowed = lambda rows: (tree.labels[rows] == labels[i]) & (tree.ids[rows] != ids[i])
                else:
                    allowed = lambda rows: tree.labels[rows] != labels[i]
                for w, (found, score) in enumerate(best_in_windows(tree, queries[i], leaves, allowed, np.array(lows[i], float), np.array(highs[i], float), k)):
                    out["anchor_id"] += [ids[i]] * len(found)
                    out["window"] += [w] * len(found)
                    out["id"] += found.tolist()
                    out["score"] += score.tolist()
        return pa.table({c: pa.array(v, pa.int32() if c == "window" else pa.int64()) for c, v in out.items()})

    pairs = held.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk"))
    return pairs.applyInArrow(work, "anchor_id long, window int, id long, score long")


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100, positives: int = 5,
                   negatives: int = 10, low: int = 30, high: int = 90, noise: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose id ``every`` divides. An anchor's positives are the first ``positives`` other rows of its label by inner
    product of the whole-number vectors (then id); for each, the first ``negatives`` rows of other labels are returned whose product
    is between ``low`` and ``high`` hundredths of the positive's. ``noise`` replaces the label. Products are exact below 2^53.
    Null or non-finite input takes no part, one row per id does (see ``whole_vectors``); vectors of unequal length
    are compared as if zeros followed. A positive with a negative product has an empty window. An empty table gives no rows.
    """
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    held = stored(whole_vectors(rows, id_col, vector, label, noise), "whole-vectors")
    trees = cover_trees(held)
    anchors = held.filter(F.col("id") % every == 0)
    endless = 1e300
    asked = anchors.withColumn("low", F.array(F.lit(-endless))).withColumn("high", F.array(F.lit(endless)))
    best = W.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    near = _searched(trees, asked, True, positives).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
    near = stored(near.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # windows in whole numbers: low * p <= 100 * n <= high * p
    p = F.col("positive_score")
    windows = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("positives"))
    asked = (anchors.join(windows, anchors["id"] == windows["anchor_id"])
             .select("id", "label", "v", "positives", F.transform("positives", lambda x: F.ceil(x["positive_score"] * low / F.lit(100.0)).cast("double")).alias("low"),
                     F.transform("positives", lambda x: F.floor(x["positive_score"] * high / F.lit(100.0)).cast("double")).alias("high")))
    asked = stored(asked, "windows")
    far = _searched(trees, asked.drop("positives"), False, negatives)
    named = asked.select(F.col("id").alias("anchor_id"), F.posexplode("positives").alias("window", "p"))
    best = W.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
    ranked = far.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    out = ranked.join(named, ["anchor_id", "window"]).select("anchor_id", "p.positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                                                             "p.positive_score", F.col("score").alias("negative_score"))
    return out.filter((p * low <= F.col("negative_score") * 100) & (F.col("negative_score") * 100 <= p * high)).select(*names)
