"""Right-closed binning by equal width, equal frequency or given edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.plans.counting import num, quantile_dict


def width_edges(df: DataFrame, col: str, n: int) -> list[float]:
    lo, hi = df.agg(F.min(num(col)), F.max(num(col))).first()
    return [lo + i * (hi - lo) / n for i in range(n)] + [hi]


def frequency_edges(df: DataFrame, col: str, n: int) -> list[float]:
    """Quantile edges; equal neighbours are merged."""
    return frequency_edges_of(df, [col], n).get(col, [])


def frequency_edges_of(df: DataFrame, cols: list[str], n: int) -> dict[str, list[float]]:
    """The edges of several columns from the same scans; columns without a value are left out."""
    return {c: sorted(set(q)) for c, q in quantile_dict(df, cols, [i / n for i in range(n + 1)]).items()}


def bin_code(col: str, edges: list[float], include_lowest: bool = True) -> Column:
    """Number of inner edges below x. Outside the edges is null, and so is the lowest edge unless included."""
    x = num(col)
    code = F.lit(0)
    for e in edges[1:-1]:
        code = code + (x > F.lit(float(e))).cast("int")
    above = x >= F.lit(float(edges[0])) if include_lowest else x > F.lit(float(edges[0]))
    return F.when(above & (x <= F.lit(float(edges[-1]))), code)


def bin_label(col: str, edges: list[float], include_lowest: bool = True, digits: int = 3) -> Column:
    """Interval text ``(low, high]``."""
    names = [f"({round(a, digits)}, {round(b, digits)}]" for a, b in zip(edges, edges[1:])]
    return F.get(F.array(*[F.lit(n) for n in names]), bin_code(col, edges, include_lowest))
