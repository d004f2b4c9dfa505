"""Arithmetic with try-semantics: what is not a number, or divides by zero, is null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def number(x: str | float | Column) -> Column:
    """A column name, a column or a constant as a double; unparsable text and NaN are null."""
    if isinstance(x, Column):
        c = x
    elif isinstance(x, str):
        c = F.col(x)
    else:
        return F.lit(float(x))
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def binary(a: str, op: str, b: str | float) -> Column:
    """``+ - * / Modulo ^``; Modulo takes the sign of the divisor."""
    x, y = number(a), number(b)
    if op == "+":
        return x + y
    if op == "-":
        return x - y
    if op == "*":
        return x * y
    if op == "/":
        return F.try_divide(x, y)
    if op == "Modulo":
        return x - y * F.floor(F.try_divide(x, y))
    if op == "^":
        return F.pow(x, y)
    raise ValueError(f"unknown operator {op!r}")


def power_ratio(a: str, b: str | float, c: str | float) -> Column:
    """a ** b / c"""
    return F.try_divide(F.pow(number(a), number(b)), number(c))


def unary(a: str, op: str) -> Column:
    """``log`` is log(1 + a), null at or below -1; ``sqrt`` sees negatives as 0."""
    x = number(a)
    if op == "log":
        return F.when(x > -1, F.log1p(x))
    if op == "exp":
        return F.exp(x)
    if op == "sqrt":
        return F.when(x.isNotNull(), F.sqrt(F.greatest(x, F.lit(0.0))))
    if op == "square":
        return x * x
    if op == "abs":
        return F.abs(x)
    raise ValueError(f"unknown operator {op!r}")


def flag_not(a: str, value: float) -> Column:
    """1 where the column differs from ``value``; null counts as different."""
    return (~number(a).eqNullSafe(F.lit(float(value)))).cast("int")
