"""Splits, balancing, class weights and schema alignment.

Shuffles are replaced by the seeded hash order of a unique key, so a row's place does not depend on
partitioning. Exact sizes come from a per-class cutoff hash (``plans.hashing``): the split itself is a
map-only projection.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from millrace.plans.counting import num, quantile_dict
from millrace.plans.hashing import class_map, hash_numbered, hash_unit, kth_smallest, within_cutoff
from millrace.plans.ordering import row_numbers


def class_sizes(df: DataFrame, target: str, limit: int = 1000) -> dict:
    """Rows per class, keyed by the class as text."""
    rows = (df.filter(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("c")).count()
            .limit(limit + 1).collect())
    if len(rows) > limit:
        raise ValueError(f"{target} has more than {limit} classes")
    return {r["c"]: r["count"] for r in rows}


def random_split(df: DataFrame, keys: list[str], test: float = 0.2, seed: int = 42, exact: bool = True) -> DataFrame:
    """``split`` = test for ceil(n·test) rows, else train. ``exact=False`` needs no count at all."""
    if not exact:
        return df.withColumn("split", F.when(hash_unit(keys, seed) < test, "test").otherwise("train"))
    k = math.ceil(df.count() * test)
    cut = kth_smallest(df, keys, seed, {None: k})
    return df.withColumn("split", F.when(within_cutoff(keys, seed, cut), "test").otherwise("train"))


def stratified_split(df: DataFrame, keys: list[str], target: str, test: float = 0.2, val: float = 0.0,
                     seed: int = 42) -> DataFrame:
    """ceil shares per class. ``val`` is a share of the whole; of the rest it takes val / (1 - test),
    kept between 0.01 and 0.99. Rows with a null class are left out."""
    sizes = class_sizes(df, target)
    tests = {c: math.ceil(n * test) for c, n in sizes.items()}
    data = df.filter(F.col(target).isNotNull())
    in_test = within_cutoff(keys, seed, kth_smallest(data, keys, seed, tests, target), target)
    split = F.when(in_test, "test")
    if val:
        share = min(max(val / (1 - test), 0.01), 0.99)
        upto = {c: tests[c] + math.ceil((n - tests[c]) * share) for c, n in sizes.items()}
        split = split.when(within_cutoff(keys, seed, kth_smallest(data, keys, seed, upto, target), target), "val")
    return data.withColumn("split", split.otherwise("train"))


def sequential_split(df: DataFrame, order: list[str], test: float = 0.2, cutoff=None) -> DataFrame:
    """The last ceil(n·test) rows by ``order`` are the test; or everything at or after ``cutoff``."""
    if cutoff is not None:
        return df.withColumn("split", F.when(F.col(order[0]) >= F.lit(cutoff), "test").otherwise("train"))
    n = df.count()
    first = n - math.ceil(n * test)
    numbered = row_numbers(df, [], order, "_i")
    return numbered.withColumn("split", F.when(F.col("_i") > first, "test").otherwise("train")).drop("_i")


def assemble(df: DataFrame, target: str, exclude: list[str] = (), require_target: bool = True) -> DataFrame:
    """Feature columns plus target; rows without a target go, excluded columns go. A test frame may lack it."""
    out = df.drop(*[c for c in exclude if c != target])
    if target not in df.columns:
        if require_target:
            raise ValueError(f"no column {target!r}")
        return out
    return out.dropna(subset=[target])


def inference_mode(test: DataFrame | None, target: str) -> bool:
    """A test frame is present but carries no label."""
    return test is not None and target not in test.columns


def inference_validation(train: DataFrame, keys: list[str], target: str, task: str, share: float = 0.2,
                         seed: int = 42) -> DataFrame:
    """Hold out a part of train when the test has no labels; stratified for classification."""
    if task == "classification":
        return stratified_split(train, keys, target, share, seed=seed)
    return random_split(train.dropna(subset=[target]), keys, share, seed)


def detect_task(df: DataFrame, target: str, domain: str | None = None) -> tuple[str, str]:
    """(task, subtask): the domain setting first, else at most 20 distinct values is a classification."""
    n = df.select(target).filter(F.col(target).isNotNull()).distinct().limit(21).count()
    if domain == "regression" or (domain is None and n > 20):
        return "regression", "continuous"
    return "classification", "binary" if n == 2 else "multiclass"


def undersample(df: DataFrame, keys: list[str], target: str, seed: int = 42) -> DataFrame:
    """Every class down to the smallest class size."""
    sizes = class_sizes(df, target)
    k = min(sizes.values())
    data = df.filter(F.col(target).isNotNull())
    cut = kth_smallest(data, keys, seed, {c: k for c in sizes}, target)
    return data.filter(within_cutoff(keys, seed, cut, target))


def oversample(df: DataFrame, keys: list[str], target: str, seed: int = 42) -> DataFrame:
    """Every class up to the largest class size: each row floor(M/n) times, the first M mod n once more."""
    sizes = class_sizes(df, target)
    top = max(sizes.values())
    data = df.filter(F.col(target).isNotNull())
    extra = within_cutoff(keys, seed, kth_smallest(data, keys, seed, {c: top % n for c, n in sizes.items()}, target), target)
    base = F.try_element_at(class_map({c: top // n for c, n in sizes.items()}), F.col(target).cast("string"))
    copies = base + extra.cast("int")
    return data.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))


def class_weights(df: DataFrame, target: str, out: str = "weight") -> DataFrame:
    """Balanced weights n / (k · n_c); null for a null class."""
    sizes = class_sizes(df, target)
    total, k = sum(sizes.values()), len(sizes)
    weights = class_map({c: total / (k * n) for c, n in sizes.items()})
    return df.withColumn(out, F.try_element_at(weights, F.col(target).cast("string")))


def folds(df: DataFrame, keys: list[str], k: int = 5, target: str | None = None, seed: int = 42) -> DataFrame:
    """``fold`` 0..k-1 by position in hash order, inside each class when a target is given."""
    numbered = hash_numbered(df, keys, seed, "_i", [target] if target else [])
    return numbered.withColumn("fold", ((F.col("_i") - 1) % k).cast("int")).drop("_i")


def align(df: DataFrame, like: DataFrame, fill: str = "zero", ignore: list[str] = ()) -> DataFrame:
    """Same columns and order as ``like``: missing ones filled with 0 or like's median or mean, extra dropped."""
    wanted = [c for c in like.columns if c not in ignore]
    absent = [c for c in wanted if c not in df.columns]
    values = {c: 0.0 for c in absent}
    if absent and fill == "median":
        values.update({c: q[0] for c, q in quantile_dict(like, absent, [0.5]).items()})
    elif absent and fill == "mean":
        row = like.agg(*[F.avg(num(c)).alias(c) for c in absent]).first()
        values.update({c: row[c] for c in absent})
    kinds = dict(like.dtypes)
    return df.select(*[F.col(c) if c in df.columns else
                       F.lit(values[c]).cast("double" if fill != "zero" else kinds[c]).alias(c) for c in wanted])


def align_report(df: DataFrame, like: DataFrame) -> DataFrame:
    """(column, status): filled, dropped or kept."""
    rows = [(c, "kept" if c in df.columns else "filled") for c in like.columns]
    rows += [(c, "dropped") for c in df.columns if c not in like.columns]
    return df.sparkSession.createDataFrame(rows, "column string, status string")
