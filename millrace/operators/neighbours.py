"""Operators on nearest neighbours: imputing, outlier factors, oversampling, voting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from millrace.plans.counting import num
from millrace.plans.hashing import hash_unit
from millrace.plans.lineage import cut
from millrace.plans.lookup import fit_lookup, join_lookup
from millrace.plans.neighbours import nearest, vector
from millrace.plans.partial import BLOCK, PIVOTS, digest, donor_means, holed


def knn_impute(df: DataFrame, cols: list[str], key: str, k: int = 5, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """Missing values become the mean of the k nearest rows that have the value.

    The distance uses the columns both rows have, scaled by all columns over those; one exact search serves all
    patterns of missing values (``plans/partial.py``). A row with nothing in common with any donor takes the
    column mean; a column without any value stays null. Equal rows are searched for once.
    """
    means = df.agg(*[F.avg(num(c)).alias(c) for c in cols]).first()
    found = donor_means(df, cols, key, k, list(means), block, pivots)
    if found is None:
        return df.withColumns({c: num(c) for c in cols})
    keyed = df.withColumn("_vk", digest(holed(cols)))
    uses = keyed.groupBy("_vk").agg(F.count(F.lit(1)).alias("n"))
    named = found.select(F.col("vk").alias("_vk"), *[F.col(f"x{i}").alias(f"_knn{i}") for i in range(len(cols))])
    lk = fit_lookup(named.join(uses, "_vk"), ["_vk"])
    out = join_lookup(keyed, lk, [f"_knn{i}" for i in range(len(cols))])
    return out.select(*[F.coalesce(num(c), F.col(f"_knn{cols.index(c)}"), F.lit(means[c])).alias(c) if c in cols else F.col(c) for c in df.columns])


def local_outlier_factor(df: DataFrame, cols: list[str], key: str, k: int = 20, threshold: float = 1.5) -> DataFrame:
    """(key, lof, is_outlier): local outlier factor over exactly k neighbours, flagged above the threshold."""
    pts = df.select(F.col(key), vector(cols).alias("v"))
    hits = nearest(pts, pts, k, key, key, exclude_same=True)
    hits = cut(hits.select(key, F.col("neighbours.dist").alias("dist"), F.col("neighbours.id").alias("id")))  # two arrays take half of what an array of structs does
    kdist = hits.select(F.col(key).alias("id"), F.element_at("dist", -1).alias("kd"))
    pairs = hits.select(key, F.explode(F.arrays_zip("dist", "id")).alias("n")).select(key, F.col("n.dist").alias("dist"), F.col("n.id").alias("id"))
    uses = fit_lookup(pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(kdist, "id"), ["id"])  # an id of several rows counts as often below
    reach = join_lookup(pairs, uses, ["kd"])
    lrd = cut(reach.groupBy(key).agg((1.0 / (F.avg(F.greatest("dist", "kd")) + F.lit(1e-10))).alias("lrd")))
    near = join_lookup(pairs.select(key, "id"), fit_lookup(uses.table.drop("kd").join(lrd.withColumnRenamed(key, "id"), "id"), ["id"]), ["lrd"])
    lof = (near.groupBy(key).agg(F.avg("lrd").alias("_near")).join(lrd, key)
           .select(key, (F.col("_near") / F.col("lrd")).alias("lof")))
    return lof.withColumn("is_outlier", (F.col("lof") > threshold).cast("int"))


def knn_predict(train: DataFrame, test: DataFrame, cols: list[str] | str, target: str, train_key: str, test_key: str,
                k: int = 5, task: str = "classification") -> DataFrame:
    """(test_key, prediction): majority vote (ties to the smallest class) or mean of the k nearest rows."""
    q = test.select(F.col(test_key), vector(cols).alias("v"))
    s = train.filter(F.col(target).isNotNull()).select(F.col(train_key).alias("_id"), vector(cols).alias("v"))
    pairs = nearest(q, s, k, test_key, "_id").select(test_key, F.explode("neighbours").alias("n")).select(test_key, F.col("n.id").alias("_id"))
    labels = train.select(F.col(train_key).alias("_id"), F.col(target).alias("_y"))
    uses = pairs.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).join(labels, "_id")
    voted = join_lookup(pairs, fit_lookup(uses, ["_id"]), ["_y"])
    if task != "classification":
        return voted.groupBy(test_key).agg(F.avg("_y").alias("prediction"))
    votes = voted.groupBy(test_key, "_y").agg(F.count(F.lit(1)).alias("c"))
    return votes.groupBy(test_key).agg(F.min(F.struct((-F.col("c")).alias("k"), F.col("_y").alias("y")))["y"].alias("prediction"))


def _synthesise(base: DataFrame, donors: DataFrame, cols: list[str], key: str, k: int, seed: int) -> DataFrame:
    """``base`` has (key, copy, v): move each copy a random share of the way to one of its k neighbours."""
    hits = nearest(donors, donors, k, key, key, exclude_same=True).filter(F.size("neighbours") > 0)
    drawn = (base.select(key, "copy", F.col("v").alias("_v")).join(hits, key)
             .withColumn("_pick", F.floor(hash_unit([key, "copy"], seed) * F.size("neighbours")).cast("int"))
             .withColumn("_u", hash_unit([key, "copy"], seed + 1))
             .select(key, "copy", "_v", "_u", F.get("neighbours", F.col("_pick"))["id"].alias("_id")))
    uses = drawn.groupBy("_id").agg(F.count(F.lit(1)).alias("n"))
    far = uses.join(donors.select(F.col(key).alias("_id"), F.col("v").alias("_w")), "_id")
    pairs = join_lookup(drawn, fit_lookup(far, ["_id"]), ["_w"])
    moved = F.zip_with("_v", "_w", lambda a, b: a + F.col("_u") * (b - a))
    return pairs.withColumn("_x", moved).select(key, "copy", F.col("_id").alias("neighbour"),
                                                *[F.col("_x")[i].alias(c) for i, c in enumerate(cols)])


def smote(df: DataFrame, cols: list[str], target: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Real rows plus synthetic ones (``synthetic`` = 1) until every class has the largest class's size.

    Row r of a class gives floor(need / n) copies, and one more for the first need mod n in hash order.
    """
    from millrace.operators.split import class_sizes
    from millrace.plans.hashing import kth_smallest, within_cutoff
    sizes = class_sizes(df, target)
    top = max(sizes.values())
    real = df.select(F.lit(0).alias("synthetic"), F.col(key), F.lit(0).cast("long").alias("neighbour"), *[num(c).alias(c) for c in cols], F.col(target))
    out = real.withColumn("neighbour", F.lit(None).cast(dict(df.dtypes)[key]))
    for cls, n in sizes.items():
        need = top - n
        if need == 0 or n < 2:
            continue
        rows = df.filter(F.col(target).cast("string") == F.lit(cls))
        extra = within_cutoff([key], seed, kth_smallest(rows, [key], seed, {None: need % n}))
        pts = rows.select(F.col(key), vector(cols).alias("v"), F.col(target), extra.alias("_e")).filter("v is not null")
        base = pts.withColumn("copy", F.explode(F.when(F.lit(need // n) + F.col("_e").cast("int") > 0,
                              F.sequence(F.lit(1), F.lit(need // n) + F.col("_e").cast("int")))))
        made = _synthesise(base, pts.select(key, "v"), cols, key, k, seed)
        value = df.schema[target].dataType
        out = out.unionByName(made.select(F.lit(1).alias("synthetic"), key, "neighbour", *cols, F.lit(cls).cast(value).alias(target)))
    return out


def adasyn(df: DataFrame, cols: list[str], target: str, key: str, minority, k: int = 5, seed: int = 42) -> DataFrame:
    """(key, copies, synthetic rows): like SMOTE for one class, with copies in proportion to the share of other
    classes among the k neighbours of a row, rounded to the nearest integer."""
    pts = df.select(F.col(key), vector(cols).alias("v"), (F.col(target) == F.lit(minority)).alias("_min")).filter("v is not null")
    n_min = pts.filter("_min").count()
    need = pts.count() - 2 * n_min
    mine = pts.filter("_min").select(key, "v")
    pairs = nearest(mine, pts.select(key, "v"), k, key, key, exclude_same=True).select(key, F.explode("neighbours").alias("n"))
    pairs = pairs.select(key, F.col("n.id").alias("_id"))
    uses = pairs.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).join(pts.select(F.col(key).alias("_id"), "_min"), "_id")
    share = cut(join_lookup(pairs, fit_lookup(uses, ["_id"]), ["_min"]).groupBy(key).agg(F.avg((~F.col("_min")).cast("double")).alias("_g")))
    total = share.agg(F.sum("_g")).first()[0] or 1.0
    copies = F.floor(F.col("_g") / F.lit(total) * F.lit(float(max(need, 0))) + 0.5).cast("int")
    base = (mine.join(share, key).withColumn("_c", copies).filter("_c > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_c")))))
    return _synthesise(base, mine, cols, key, k, seed)
