"""Projections, previews, user expressions and column edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def preview(df: DataFrame, where: str | None = None, order_by: list[Column] | None = None,
            columns: list[str] | None = None, n: int = 10) -> DataFrame:
    """Filter, sort, project, first ``n`` rows: a top-k plan when an order is given."""
    out = df.filter(F.expr(where)) if where else df
    if order_by:
        out = out.orderBy(*order_by)
    if columns:
        out = out.select(*columns)
    return out.limit(n)


def new_columns(df: DataFrame, original: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in set(original)])


def formulas(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """New or replaced columns from SQL expressions, checked by the analyser before anything runs."""
    out = df
    for name, text in exprs.items():
        out = out.withColumn(name, F.expr(text))
    return out


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def duplicate_column(df: DataFrame, source: str, target: str) -> DataFrame:
    if target in df.columns:
        raise ValueError(f"column {target!r} exists")
    return df.withColumn(target, F.col(source))


def set_kind(df: DataFrame, col: str, kind: str) -> DataFrame:
    """Record a chosen kind in the column's metadata; profiling then keeps it."""
    return df.withMetadata(col, {**df.schema[col].metadata, "kind": kind})


def on_each(frames: dict[str, DataFrame], operation) -> dict[str, DataFrame]:
    """Apply one operation to several named frames; each result is computed from its own rows."""
    return {name: operation(df) for name, df in frames.items()}
