"""Null-safe equi-joins by column name."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join where NULL matches NULL; the right copies of the keys are dropped."""
    if not keys:
        raise ValueError("a join needs keys")
    renamed = right.select(*[F.col(k).alias(f"_r_{i}") for i, k in enumerate(keys)],
                           *[F.col(c) for c in right.columns if c not in keys])
    cond = reduce(and_, [left[k].eqNullSafe(renamed[f"_r_{i}"]) for i, k in enumerate(keys)])
    out = left.join(renamed, cond, how)
    return out.drop(*[f"_r_{i}" for i in range(len(keys))])
