"""Property graphs as edge tables (src, dst). Undirected operators drop repeated edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.operators.charts import histogram
from millrace.plans.lineage import cut
from millrace.plans.lookup import fit_lookup, join_lookup

LARGE_EDGES = 1_000_000


def simple_edges(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Distinct edges; the ends of an undirected edge are put in order."""
    e = edges.select("src", "dst").dropna()
    if not directed:
        e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return e.distinct()


def node_ids(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return (ids.unionByName(nodes.select("id")) if nodes is not None else ids).distinct()


def degrees(edges: DataFrame, nodes: DataFrame | None = None, directed: bool = False) -> DataFrame:
    """(id, degree): a self loop counts twice; isolated nodes (from ``nodes``) have degree 0."""
    return _degrees(simple_edges(edges, directed), nodes)


def _degrees(simple: DataFrame, nodes: DataFrame | None) -> DataFrame:
    ends = simple.select(F.explode(F.array("src", "dst")).alias("id"), F.lit(1).alias("d"))
    if nodes is not None:
        ends = ends.unionByName(nodes.select("id", F.lit(0).alias("d")))
    return ends.groupBy("id").agg(F.sum("d").alias("degree"))


def summary(edges: DataFrame, nodes: DataFrame | None = None, directed: bool = False) -> DataFrame:
    """(nodes, edges, directed, density, mean_degree, max_degree)"""
    e = cut(simple_edges(edges, directed))
    m = e.count()
    d = _degrees(e, nodes).agg(F.count(F.lit(1)).alias("nodes"), F.avg("degree").alias("mean_degree"),
                                            F.max("degree").alias("max_degree"))
    pairs = F.col("nodes").cast("double") * (F.col("nodes") - 1)
    return d.select("nodes", F.lit(m).cast("long").alias("edges"), F.lit(directed).alias("directed"),
                    F.coalesce(F.try_divide(F.lit(float(m if directed else 2 * m)), pairs), F.lit(0.0)).alias("density"),
                    "mean_degree", "max_degree")


def degree_histogram(edges: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(degrees(edges), "degree", bins)


def top_degree(edges: DataFrame, n: int = 15) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(n)


def node_features(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, degree, centrality): centrality is degree / (n - 1)."""
    d = degrees(edges, nodes)
    n = d.count()
    return d.withColumn("centrality", F.col("degree") / F.lit(float(max(n - 1, 1))))


def adjacency(edges: DataFrame, wide: bool = False, cap: int = 500) -> DataFrame:
    """(src, dst, weight) coordinates; ``wide`` pivots the columns when there are at most ``cap`` of them."""
    coords = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    if not wide:
        return coords
    cols = [r[0] for r in edges.select("dst").distinct().orderBy("dst").limit(cap + 1).collect()]
    if len(cols) > cap:
        raise ValueError(f"more than {cap} columns; use the coordinate form")
    return coords.groupBy("src").pivot("dst", cols).sum("weight").fillna(0)


def subgraph(edges: DataFrame, n: int) -> DataFrame:
    """Edges between the first ``n`` nodes in id order."""
    keep = node_ids(edges).orderBy("id").limit(n)
    return (edges.join(F.broadcast(keep.withColumnRenamed("id", "src")), "src", "left_semi")
            .join(F.broadcast(keep.withColumnRenamed("id", "dst")), "dst", "left_semi").select("src", "dst"))


def from_triples(t: DataFrame) -> DataFrame:
    return t.filter("o_type <> 'literal'").select(F.col("s").alias("src"), F.col("o").alias("dst"), F.col("p").alias("label"))


def _linked(pairs: DataFrame, large: bool) -> DataFrame:
    """(node, other) with the smallest of node and its others added as ``m``. In a large graph the hot nodes
    are split off; a small one (counted) is joined as it is."""
    least = pairs.groupBy("node").agg(F.min("other").alias("_m"), F.count(F.lit(1)).alias("n"))
    if not large:
        return pairs.join(least.drop("n"), "node").withColumn("m", F.least("node", "_m"))
    return join_lookup(pairs, fit_lookup(least, ["node"]), ["_m"]).withColumn("m", F.least("node", "_m"))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id of each undirected component.

    Nodes with a single neighbour, where they are the greater part, are folded into it first: they link nothing else,
    so only the other edges go through the rounds. The component of a neighbour then reaches them by a measured look-up.
    """
    e = cut(simple_edges(edges).filter("src <> dst"))
    ends = e.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(e.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    met = cut(ends.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("other")))
    single, total = met.agg(F.sum((F.col("n") == 1).cast("long")), F.count(F.lit(1))).first()
    labelled = _folded(e, met, max_rounds) if total and 2 * single > total else _rounds(e, max_rounds)
    ids = node_ids(edges, nodes)
    return ids.join(labelled, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _folded(e: DataFrame, met: DataFrame, max_rounds: int) -> DataFrame:
    """(id, component) of all nodes of ``e``; ``met`` has their numbers of neighbours ``n`` and the smallest neighbour.

    The two ends of an edge that stands alone are folded into each other, and both find the smaller.
    """
    inner = met.filter("n > 1").select("id", "n")
    rest = e
    for c in ("src", "dst"):
        lk = fit_lookup(inner.select(F.col("id").alias(c), "n", F.lit(True).alias("_in")), [c])
        rest = join_lookup(rest, lk, ["_in"]).filter("_in").drop("_in")
    of_inner = cut(_rounds(cut(rest), max_rounds))
    least = met.filter("n = 1").groupBy(F.col("other").alias("id")).agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    roots = inner.select("id", F.lit(None).cast(least.schema["low"].dataType).alias("low"), F.lit(0).cast("long").alias("n")).unionByName(least.select("id", "low", "n"))
    roots = roots.groupBy("id").agg(F.min("low").alias("low"), F.sum("n").alias("n"))
    roots = cut(roots.join(of_inner, "id", "left").withColumn("component", F.coalesce("component", "id")))
    whole = roots.groupBy("component").agg(F.min(F.least("component", "low")).alias("_low"), F.count(F.lit(1)).alias("n"))
    named = cut(join_lookup(roots, fit_lookup(whole, ["component"]), ["_low"]).select("id", "n", F.col("_low").alias("component")))
    asked = met.filter("n = 1").select(F.col("id").alias("_leaf"), F.col("other").alias("id"))
    leaves = join_lookup(asked, fit_lookup(named, ["id"]), ["component"]).select(F.col("_leaf").alias("id"), "component")
    return leaves.unionByName(named.join(inner.select("id"), "id", "left_semi").select("id", "component"))


def _rounds(edges: DataFrame, max_rounds: int) -> DataFrame:
    """(id, component) of the nodes that are not the smallest of their component, by alternating large-star and
    small-star steps (Kiveris et al., 2014).

    ``edges`` are distinct, with src < dst. A step keeps at most the number of edges it had and is cut from its
    lineage; it stops when the edges no longer change.
    """
    e = edges.select(F.col("dst").alias("u"), F.col("src").alias("v"))
    seen = None
    big = e.count() > LARGE_EDGES
    for _ in range(max_rounds):
        both = e.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(
            e.select(F.col("v").alias("node"), F.col("u").alias("other")))
        large = cut(_linked(both, big).filter("other > node").select(F.col("other").alias("u"), F.col("m").alias("v")).distinct())
        down = large.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("other"))
        linked = _linked(down, big)
        small = (linked.filter("other <> m").select(F.col("other").alias("u"), F.col("m").alias("v"))
                 .unionByName(linked.select(F.col("node").alias("u"), F.col("m").alias("v"))).distinct())
        e = cut(small)
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
