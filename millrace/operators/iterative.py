"""Iterative operators: chained-equation imputing, isolation forest, density clustering, walks, linking."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from millrace.operators.graph import connected_components, simple_edges
from millrace.plans.balls import at_home, cover, forest, lowest, weigh, within
from millrace.plans.counting import num, quantile_dict
from millrace.plans.hashing import hash_unit
from millrace.plans.lineage import cut
from millrace.plans.lookup import fit_lookup, join_lookup
from millrace.plans.neighbours import no_rows, vector
from millrace.plans.ordering import row_numbers

BLOCK = 2_000


def chained_impute(df: DataFrame, cols: list[str], rounds: int = 10) -> DataFrame:
    """Each incomplete column is predicted from the others by least squares, fewest gaps first, for a number
    of rounds starting from the column means.

    A fit is one aggregate of means and covariances over the rows that have the value, solved on the driver
    (columns × columns numbers). Each round is cut from its lineage.
    """
    stats = df.agg(*[F.avg(num(c)).alias(f"m_{c}") for c in cols], *[F.sum(num(c).isNull().cast("long")).alias(f"k_{c}") for c in cols]).first()
    gaps = sorted([c for c in cols if stats[f"k_{c}"]], key=lambda c: (stats[f"k_{c}"], cols.index(c)))
    if not gaps:
        return df
    work = df.withColumns({f"_gap_{c}": num(c).isNull() for c in gaps}).withColumns(
        {c: F.coalesce(num(c), F.lit(stats[f"m_{c}"])) for c in cols})
    for _ in range(rounds):
        for c in gaps:
            x = [o for o in cols if o != c]
            names = [*x, c]
            pairs = list(itertools.combinations_with_replacement(names, 2))
            row = work.filter(~F.col(f"_gap_{c}")).agg(*[F.avg(a) for a in names], *[F.covar_pop(a, b) for a, b in pairs]).first()
            mean = dict(zip(names, row[:len(names)]))
            cov = {**{p: v for p, v in zip(pairs, row[len(names):])}}
            at = lambda a, b: cov.get((a, b), cov.get((b, a)))
            a = np.array([[at(p, q) for q in x] for p in x], dtype=float)
            beta = np.linalg.lstsq(a, np.array([at(p, c) for p in x], dtype=float), rcond=None)[0]
            guess = F.lit(float(mean[c] - sum(b * mean[p] for b, p in zip(beta, x))))
            for b, p in zip(beta, x):
                guess = guess + F.lit(float(b)) * F.col(p)
            work = work.withColumn(c, F.when(F.col(f"_gap_{c}"), guess).otherwise(F.col(c)))
        work = cut(work)
    return work.drop(*[f"_gap_{c}" for c in gaps])


# isolation forest -------------------------------------------------------------------------------------

def _mean_path(n: float) -> float:
    """Average path length of an unsuccessful search in a tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def isolation_forest(df: DataFrame, cols: list[str], key: str, trees: int = 100, sample: int = 256,
                     contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """(key, score, is_outlier): random isolation trees, the top share by score flagged.

    Every tree is grown in its own task from about ``sample`` hash-chosen rows; the trees together are a
    few ten thousand nodes, which go to the scoring tasks as arrays.
    """
    data = df.select(F.col(key), vector(cols).alias("v")).filter("v is not null")
    n = data.count()
    if n >= trees * sample:
        picked = data.filter(hash_unit([key], seed) < trees * sample / n).withColumn("tree", F.floor(hash_unit([key], seed + 1) * trees).cast("int"))
    else:
        picked = data.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).filter(hash_unit([key, "tree"], seed) < sample / max(n, 1))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x, tree = np.stack(pdf["v"].to_numpy()), int(pdf["tree"].iloc[0])
        rng, nodes = np.random.default_rng([seed, tree]), []
        limit = math.ceil(math.log2(max(len(x), 2)))
        todo = [(0, np.arange(len(x)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            sub = x[rows]
            wide = np.nonzero(sub.max(0) > sub.min(0))[0]
            if depth >= limit or len(rows) <= 1 or len(wide) == 0:
                nodes.append((tree, node, -1, 0.0, depth + _mean_path(len(rows))))
                continue
            f = int(rng.choice(wide))
            at = float(rng.uniform(sub[:, f].min(), sub[:, f].max()))
            nodes.append((tree, node, f, at, 0.0))
            left = sub[:, f] < at
            todo += [(2 * node + 1, rows[left], depth + 1), (2 * node + 2, rows[~left], depth + 1)]
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "split", "path"])

    grown = picked.groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, split double, path double").toPandas()
    size = int(grown["node"].max()) + 1
    ids = {t: i for i, t in enumerate(sorted(grown["tree"].unique()))}
    feature, split, path = (np.full((len(ids), size), v) for v in (-1, 0.0, 0.0))
    rows = grown["tree"].map(ids).to_numpy()
    feature[rows, grown["node"]], split[rows, grown["node"]], path[rows, grown["node"]] = grown["feature"], grown["split"], grown["path"]
    norm = _mean_path(min(sample, n))

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=float)
        x = np.stack(v.to_numpy())
        total = np.zeros(len(x))
        for t in range(len(ids)):
            node = np.zeros(len(x), dtype=int)
            while True:
                f = feature[t, node]
                live = f >= 0
                if not live.any():
                    break
                right = x[np.arange(len(x)), np.where(live, f, 0)] >= split[t, node]
                node = np.where(live, 2 * node + 1 + right, node)
            total += path[t, node]
        return pd.Series(2.0 ** (-(total / len(ids)) / norm))

    scored = cut(data.select(key, score("v").alias("score")))
    edge = quantile_dict(scored, ["score"], [1 - contamination])["score"][0]
    return scored.withColumn("is_outlier", (F.col("score") > edge).cast("int"))


# density clustering -----------------------------------------------------------------------------------

def _against(queries: DataFrame, points: DataFrame, sizes: DataFrame, eps: float, block: int) -> DataFrame:
    """(vk, cell, within): weight of the points of ``cell`` within eps of each query (vk, v, cell).

    Points (cell, vk, v, n) and queries of a cell are dealt into blocks of bounded size, every query block
    meets every point block; ``sizes`` has the points per cell. Only one number per query and block leaves
    a task.
    """
    asked = queries.groupBy("cell").agg(F.count(F.lit(1)).alias("q"))
    plan = sizes.select("cell", "m").join(asked, "cell").select(
        "cell", (F.col("m") + F.col("q")).alias("n"), F.ceil(F.col("m") / block).cast("int").alias("_nb"),
        F.ceil(F.col("q") / block).cast("int").alias("_nq"))
    lk = fit_lookup(plan, ["cell"])
    deal = lambda df, mine, other: (join_lookup(df, lk, ["_nb", "_nq"]).filter("_nb is not null")
                                    .withColumn(mine[0], F.pmod(F.xxhash64("vk"), F.col(mine[1])).cast("int"))
                                    .withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other[1]) - 1))))
    q = deal(queries, ("qb", "_nq"), ("b", "_nb")).select("cell", "b", "qb", "vk", "v")
    p = deal(points, ("b", "_nb"), ("qb", "_nq")).select("cell", "b", "qb", "v", "n")

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return no_rows("vk", "cell", "within")
        b, w = np.stack(right["v"].to_numpy()), right["n"].to_numpy()
        out = []
        step = max(8_000_000 // b.size, 1)
        for i in range(0, len(left), step):
            a = np.stack(left["v"].to_numpy()[i:i + step])
            d = ((a[:, None, :] - b[None, :, :]) ** 2).sum(2)
            out.append(((d <= eps * eps) * w[None, :]).sum(1))
        return pd.DataFrame({"vk": left["vk"], "cell": left["cell"], "within": np.concatenate(out).astype("int64")})

    q, p = q.toDF(*q.columns), p.toDF(*p.columns)  # both sides may come from one frame
    return q.groupBy("cell", "b", "qb").cogroup(p.groupBy("cell", "b", "qb")).applyInPandas(count, "vk string, cell string, within long")


def _grid_cells(base: DataFrame, d: int, eps: float):
    """Cells of diameter eps as a grid; the neighbouring ones are enumerated, so for few columns only."""
    side = eps / math.sqrt(d) * (1 - 1e-9)
    base = cut(base.withColumn("at", F.transform("v", lambda x: F.floor(x / side).cast("long"))).withColumn("cell", F.concat_ws(",", "at")))
    cells = cut(base.groupBy("cell").agg(F.first("at").alias("at"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("m")))
    reach = math.ceil(math.sqrt(d))
    steps = [o for o in itertools.product(range(-reach, reach + 1), repeat=d) if any(o)
             and sum(max(abs(x) - 1, 0) ** 2 for x in o) * side * side <= eps * eps]
    offs = F.array(*[F.array(*[F.lit(x).cast("long") for x in o]) for o in steps])
    moved = F.concat_ws(",", F.zip_with("at", "_o", lambda a, b: a + b))
    near = cut(cells.select("cell", "at", F.explode(offs).alias("_o")).select("cell", moved.alias("other"))
               .join(cells.select(F.col("cell").alias("other")), "other", "left_semi"))
    box = F.zip_with("v", F.transform(F.split("other", ","), lambda t: t.cast("long")), lambda x, k: F.greatest(
        k * F.lit(side) - x, x - (k + 1) * F.lit(side), F.lit(0.0)))
    reachable = F.aggregate(F.transform(box, lambda g: g * g), F.lit(0.0), lambda s, g: s + g) <= eps * eps * (1 + 1e-9)
    return base.drop("at"), cells, near, lambda pairs: pairs.filter(reachable)


def _grid_clusters(base: DataFrame, d: int, eps: float, min_points: int, block: int, representatives: int) -> DataFrame:
    """(vk, n, core, cluster or null) of distinct points (vk, v, n, first)."""
    base, cells, near, aimed = _grid_cells(base, d, eps)
    base = cut(join_lookup(base, fit_lookup(cells.select("cell", "total", F.col("m").alias("n")), ["cell"]), ["total"]))

    def probes(points: DataFrame, pairs: DataFrame) -> DataFrame:
        """(vk, cell, v, other): the points of a cell against the cells of its pairs that can hold points within eps."""
        return aimed(points.select("cell", "vk", "v").join(pairs, "cell"))

    asked = probes(base.filter(F.col("total") < min_points), near).select("vk", "v", F.col("other").alias("cell"))
    extra = _against(asked, base.select("cell", "vk", "v", "n"), cells, eps, block).groupBy("vk").agg(F.sum("within").alias("extra"))
    flagged = cut(base.join(extra, "vk", "left")
                  .withColumn("core", F.col("total") + F.coalesce("extra", F.lit(0)) >= min_points)
                  .select("vk", "v", "n", "first", "cell", "core"))
    cores = flagged.filter("core")
    csize = cut(cores.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.min("first").alias("first")))

    # cell edges: first by a few representatives, the rest by blocks
    links = (near.filter("cell < other").join(csize.select("cell"), "cell", "left_semi")
             .join(csize.select(F.col("cell").alias("other")), "other", "left_semi"))
    place = F.row_number().over(W.partitionBy("cell").orderBy("vk"))
    reps = (cores.withColumn("_i", place).filter(F.col("_i") <= representatives).groupBy("cell").agg(F.collect_list("v").alias("vs")))
    dist2 = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    tested = (links.join(reps, "cell").join(reps.select(F.col("cell").alias("other"), F.col("vs").alias("ws")), "other")
              .withColumn("hit", F.exists("vs", lambda a: F.exists("ws", lambda b: dist2(a, b) <= eps * eps))))
    tested = cut(tested.select("cell", "other", "hit"))
    open_ = tested.filter("not hit").select("cell", "other")
    reaching = probes(cores, open_).select(F.concat_ws("|", "vk", "cell").alias("vk"), "v", F.col("other").alias("cell"))
    met = (_against(reaching, cores.select("cell", "vk", "v", F.lit(1).alias("n")), csize, eps, block).filter("within > 0")
           .select(F.substring_index("vk", "|", -1).alias("cell"), F.col("cell").alias("other")).distinct())
    edges = tested.filter("hit").select("cell", "other").unionByName(met).select(F.col("cell").alias("src"), F.col("other").alias("dst"))
    comp = connected_components(edges, csize.select(F.col("cell").alias("id"))).withColumnRenamed("id", "cell")
    heads = comp.join(csize, "cell").groupBy("component").agg(F.min("first").alias("first"))
    numbered = row_numbers(heads, [], ["first"], "cluster").select("component", (F.col("cluster") - 1).alias("cluster"))
    label = cut(comp.join(numbered, "component").select("cell", "cluster"))

    border = flagged.filter("not core")
    own = border.join(label, "cell").select("vk", "cluster")
    ask = probes(border, near).select("vk", "v", F.col("other").alias("cell"))
    touch = (_against(ask, cores.select("cell", "vk", "v", F.lit(1).alias("n")), csize, eps, block).filter("within > 0")
             .join(label, "cell").select("vk", "cluster"))
    of_border = own.unionByName(touch).groupBy("vk").agg(F.min("cluster").alias("cluster"))
    sized = label.join(csize.select("cell", F.col("m").alias("n")), "cell")
    of_core = join_lookup(cores, fit_lookup(sized, ["cell"]), ["cluster"]).select("vk", "cluster")
    return flagged.select("vk", "n", "core").join(of_core.unionByName(of_border), "vk", "left")


def _ball_clusters(base: DataFrame, eps: float, min_points: int, block: int) -> DataFrame:
    """(vk, n, core, cluster or null) of distinct points (vk, v, n, first), in any number of columns.

    A ball of radius eps / 2 with ``min_points`` rows is all core; so is a point with that many near rows in its
    own block, and only the others are counted against all. Balls with core points are linked inside blocks, dealt
    by two sets of pivots; whatever that leaves apart is linked through all points, where the largest component
    need not ask: a link between two components has an end outside of it.
    """
    base = cut(base)
    covered = cut(cover(base.select("vk", "v"), eps / 2 * (1 - 1e-9), block).select("vk", F.col("centre").alias("cell")).join(base, "vk"))
    totals = covered.groupBy("cell").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n"))
    covered = join_lookup(covered, fit_lookup(totals, ["cell"]), ["total"])
    home = at_home(base.select("vk", "v", "n"), eps, block, weigh, "vk string, within long").withColumnRenamed("within", "home")
    settled = (F.col("total") >= min_points) | (F.col("home") >= min_points)
    covered = cut(covered.join(home, "vk").withColumn("settled", settled).drop("home", "total"))
    found = within(cut(covered.filter("not settled").select("vk", "v")), covered.select("vk", "v", "n"), eps, block, weigh, "vk string, within long")
    found = found.groupBy("vk").agg(F.sum("within").alias("within"))
    core = F.col("settled") | (F.coalesce("within", F.lit(0)) >= min_points)
    flagged = cut(covered.join(found, "vk", "left").withColumn("core", core).select("vk", "v", "n", "first", "cell", "core"))
    cores = flagged.filter("core").withColumn("node", F.col("cell"))
    balls = cut(cores.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first")))

    link = "src string, dst string"
    inside = [at_home(cores.select("vk", "v", "node"), eps, block, forest, link, turned) for turned in (False, True)]
    parts = connected_components(cut(inside[0].unionByName(inside[1])), balls.select(F.col("cell").alias("id"))).withColumnRenamed("id", "cell")
    parts = cut(parts.join(balls, "cell"))
    largest = parts.groupBy("component").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "component").first()
    if largest is not None and parts.select("component").distinct().count() > 1:
        named = join_lookup(cores.drop("node"), fit_lookup(parts.select("cell", "component", "n"), ["cell"]), ["component"])
        named = cut(named.withColumnRenamed("component", "node").select("vk", "v", "node"))
        apart = within(cut(named.filter(F.col("node") != largest["component"])), named, eps, block, forest, link)
        joined = connected_components(cut(apart), parts.select(F.col("component").alias("id")).distinct())
        whole = joined.select(F.col("id").alias("component"), F.col("component").alias("_whole"))
        parts = cut(parts.join(whole, "component").drop("component").withColumnRenamed("_whole", "component"))
    heads = parts.groupBy("component").agg(F.min("first").alias("first"))
    numbered = row_numbers(heads, [], ["first"], "cluster").select("component", (F.col("cluster") - 1).alias("cluster"))
    label = parts.join(numbered, "component").select("cell", "cluster", "n")
    of_core = cut(join_lookup(cores.select("vk", "v", "cell"), fit_lookup(label, ["cell"]), ["cluster"]).select("vk", "v", "cluster"))
    touch = within(flagged.filter("not core").select("vk", "v"), of_core, eps, block, lowest, "vk string, cluster long")
    of_border = touch.groupBy("vk").agg(F.min("cluster").alias("cluster"))
    return flagged.select("vk", "n", "core").join(of_core.select("vk", "cluster").unionByName(of_border), "vk", "left")


def dbscan(df: DataFrame, cols: list[str] | str, key: str, eps: float = 0.5, min_points: int = 5, block: int = BLOCK,
           representatives: int = 16, balls: bool | None = None) -> DataFrame:
    """(key, cluster, core): density clusters numbered by their smallest core key, -1 for noise, exact.

    Space is cut into cells of diameter eps, so a cell with ``min_points`` rows is all core without a
    comparison, and one edge between two cells stands for all their pairs. Up to four columns the cells are a
    grid, beyond (or by ``balls``) they are balls of radius eps / 2. A border row near several clusters joins
    the one with the smallest number. Rows with a null are left out. ``cols`` may name one array column. Grid cells
    are first linked through ``representatives`` of their points.
    """
    rows = df.select(F.col(key), vector(cols).alias("v")).filter("v is not null").withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    base = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).withColumn("vk", F.md5(F.to_json("v")))
    if balls or (balls is None and (isinstance(cols, str) or len(cols) > 4)):
        found = _ball_clusters(base, eps, min_points, block)
    else:
        found = _grid_clusters(base, len(cols), eps, min_points, block, representatives)
    final = found.withColumn("cluster", F.coalesce("cluster", F.lit(-1).cast("long")))
    keyed = rows.select(key, F.md5(F.to_json("v")).alias("vk"))
    return join_lookup(keyed, fit_lookup(final, ["vk"]), ["cluster", "core"]).select(key, "cluster", "core")


# graph walks and entity linking -----------------------------------------------------------------------

def random_walks(edges: DataFrame, length: int = 80, walks: int = 10, seed: int = 42) -> DataFrame:
    """(start, walk, path): uniform random walks over undirected edges.

    Neighbours are numbered per node, and a step is an equi-join on (node, drawn number): walkers standing
    on a hot node spread over its numbers. A walk carries the degree of its node, so a step is one join.
    """
    e = simple_edges(edges).filter("src <> dst")
    both = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = cut(both.groupBy("src").agg(F.count(F.lit(1)).alias("n")))
    numbered = row_numbers(both, ["src"], ["dst"], "i")
    lk = fit_lookup(degree.select(F.col("src").alias("dst"), "n", F.col("n").alias("deg")), ["dst"])
    steps = cut(join_lookup(numbered, lk, ["deg"]).select("src", "i", "dst", "deg"))
    state = degree.select(F.col("src").alias("start"), F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk"), F.col("n").alias("deg"))
    state = state.withColumn("path", F.array("start")).withColumn("src", F.col("start"))
    for k in range(1, length):
        u = F.conv(F.substring(F.md5(F.concat_ws("#", F.col("start"), F.col("walk"), F.lit(f"{k}#{seed}"))), 1, 8), 16, 10).cast("long")
        drawn = state.withColumn("i", u % F.col("deg") + 1).drop("deg")
        state = drawn.join(steps, ["src", "i"]).select("start", "walk", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("src"), "deg")
        if k % 8 == 0:
            state = cut(state)
    return state.select("start", "walk", "path")


def node_embeddings(edges: DataFrame, dimensions: int = 128, length: int = 80, walks: int = 10, seed: int = 42) -> DataFrame:
    """(id, embedding) from skip-gram over uniform walks (return and in-out parameters 1)."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array
    paths = cut(random_walks(edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")), length, walks, seed))
    model = Word2Vec(vectorSize=dimensions, inputCol="path", outputCol="_v", minCount=0, seed=seed, maxIter=1).fit(paths)
    return model.getVectors().select(F.col("word").alias("id"), vector_to_array("vector").alias("embedding"))


def shingles(col: str, n: int = 3):
    """Distinct lower-cased character n-grams; shorter text is one shingle."""
    s = F.lower(F.col(col))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substring(s, i, n))
    return F.array_distinct(grams)


LIST_NAMES = 1_000


def jaccard_links(a: DataFrame, b: DataFrame, left: str, right: str, threshold: float = 0.5, n: int = 3,
                  list_names: int = LIST_NAMES) -> DataFrame:
    """(left, right, jaccard) of all pairs of distinct names at or above the threshold, exact.

    Positional prefix filter: with tokens ordered from rare to frequent, two sets that similar must share one of
    the first size - ceil(t * size) + 1 tokens of each. Two names that meet on a token are dropped when their
    sizes, or the tokens left behind it, cannot reach the overlap that the threshold asks for. A pair is scored
    only under the first prefix token that the two have in common, so it appears once. The list of a frequent
    token is dealt into parts of about ``list_names`` names a side, so no task holds all its names.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and at most at 1")
    sa = cut(a.select(F.col(left).alias("l")).dropna().distinct().select("l", shingles("l", n).alias("s")))
    sb = cut(b.select(F.col(right).alias("r")).dropna().distinct().select("r", shingles("r", n).alias("s")))
    tokens = sa.select(F.explode("s").alias("t")).unionByName(sb.select(F.explode("s").alias("t")))
    freq = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    lk = fit_lookup(freq.withColumn("f", F.col("n")), ["t"])
    least = lambda size: F.ceil(F.lit(threshold) * size - F.lit(1e-9)).cast("int")

    def prefixed(df: DataFrame, key: str, name: str) -> DataFrame:
        tok = join_lookup(df.select(key, F.explode("s").alias("t")), lk, ["f"])
        per = tok.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "t"))), lambda x: x["t"]).alias(name))  # a name is short
        keep = F.size(name) - least(F.size(name)) + 1
        return per.select(key, name, F.posexplode(F.slice(name, 1, keep)).alias(f"_{name}", "t"))

    x, y = cut(prefixed(sa, "l", "x")), cut(prefixed(sb, "r", "y"))
    parts = lambda df, c: df.groupBy("t").agg(F.count(F.lit(1)).alias(f"n{c}"), F.ceil(F.count(F.lit(1)) / list_names).cast("int").alias(c))
    both = fit_lookup(parts(x, "_p").join(parts(y, "_q"), "t").withColumn("n", F.col("n_p") + F.col("n_q")), ["t"])
    part = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    x = join_lookup(x, both, ["_p", "_q"]).filter("_p is not null").withColumn("i", part("l", "_p")).withColumn("j", every("_q")).drop("_p", "_q")
    y = join_lookup(y, both, ["_p", "_q"]).filter("_p is not null").withColumn("j", part("r", "_q")).withColumn("i", every("_p")).drop("_p", "_q")
    p, q = F.size("x"), F.size("y")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (p + q) - F.lit(1e-9))
    rest = F.least(p - F.col("_x"), q - F.col("_y"))  # this token and those behind it on both sides
    met_before = F.arrays_overlap(F.slice("x", 1, F.col("_x")), F.slice("y", 1, F.col("_y")))
    cand = x.join(y, ["t", "i", "j"]).filter((rest >= need) & ~met_before)
    shared = F.size(F.array_intersect("x", "y"))
    scored = cand.withColumn("jaccard", shared / (p + q - shared)).filter(F.col("jaccard") >= threshold)
    return scored.select(F.col("l").alias(left), F.col("r").alias(right), "jaccard")
