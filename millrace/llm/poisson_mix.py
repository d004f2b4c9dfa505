"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

A source's repetition rate is its target share of the mixture over its share of the corpus. Each document draws its
number of copies by inverting the Poisson distribution of that mean at a number that its own hash gives, is exploded,
and all copies are put into one global hash order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.shared import let, uniform
from millrace.plans.lookup import fit_lookup, join_lookup

STEP = 256.0   # a larger mean is drawn as a sum of Poisson numbers of at most this mean


def source_key(source: Column) -> Column:
    """The source as a key that is never null: documents without source are a source of their own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def units(text: Column) -> Column:
    """A document's size: its code points, one at least."""
    return F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(1)).cast("long")


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, flatten: float = 0.5,
                     total: float | None = None, text: str = "text", source: str = "source") -> DataFrame:
    """(key, n, size, rate): one row per source.

    ``weights`` are the target shares by source (scaled to sum to one; a source not named gets none). Without them the
    share of a source grows as its size to the power ``flatten``. ``total`` is the size of the mixture in code
    points; by default that of the corpus.
    """
    sizes = docs.groupBy(source_key(F.col(source)).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(units(F.col(text))).alias("size"))
    if weights is None:
        share = F.pow(F.col("size").cast("double"), F.lit(flatten))
    else:
        given = F.create_map(*[F.lit(x) for s, w in weights.items() for x in ("-" if s is None else f"={s}", float(w))]) if weights else None
        share = F.coalesce(F.try_element_at(given, F.col("key")), F.lit(0.0)) if weights else F.lit(0.0)
    sums = sizes.select(share.alias("share"), "size").agg(F.sum("share").alias("_shares"), F.sum("size").alias("_total"))
    wanted = F.col("_total").cast("double") if total is None else F.lit(float(total))
    rate = F.when(F.col("_shares") > 0, share / F.col("_shares") * wanted / F.col("size")).otherwise(F.lit(0.0))
    return sizes.join(F.broadcast(sums)).select("key", "n", "size", rate.alias("rate"))  # sums is one row


def _with_steps(rates: DataFrame) -> DataFrame:
    """rates with ``steps`` (draws to add up) and ``cdf``, the distribution function of one draw until it is one."""
    steps = F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int")
    mean = F.col("rate") / steps
    last = F.ceil(mean + F.sqrt(mean) * 12 + 40).cast("int")   # beyond it less than 2^-60 remains, below the grain of the draw
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    grown = F.aggregate(F.sequence(F.lit(1), last), start, lambda a, k: let(a["p"] * mean / k, lambda p: F.struct(
        p.alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + p)).alias("cdf"))))
    return rates.select("*", steps.alias("steps"), grown["cdf"].alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, flatten: float = 0.5, total: float | None = None,
                seed: int = 1, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents repeated to their target weights, in a global hash order; copy (from 1), repetitions, rate and
    mix_order are added.

    The copies of a document depend on its id, its text and the seed, not on partitions or other rows; equal rows draw
    the same number. Null ids and texts count as empty, a null source as a source of its own, an empty table
    gives an empty mixture. Input columns named like an added one are replaced.
    """
    if flatten < 0 or (total is not None and not 0 <= total < math.inf) or any(w < 0 for w in (weights or {}).values()):
        raise ValueError("weights, flatten and total must not be negative")
    keep = [c for c in docs.columns if c not in ("copy", "repetitions", "rate", "mix_order")]
    rates = fit_lookup(_with_steps(repetition_rates(docs, weights, flatten, total, text, source)), ["key"])
    keyed = docs.select(F.struct(*keep).alias("doc"), source_key(F.col(source)).alias("key"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                        F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"))
    draws = F.transform(F.sequence(F.lit(1), F.col("steps")), lambda i: let(
        F.struct(uniform(seed, F.col("id"), F.col("digest"), i).alias("u"), F.col("cdf").alias("cdf")),
        lambda s: F.size(F.filter(s["cdf"], lambda c: c <= s["u"]))))
    count = F.aggregate(draws, F.lit(0), lambda a, d: a + d).cast("long")
    drawn = join_lookup(keyed, rates, ["rate", "steps", "cdf"]).select("doc", "id", "digest", "rate", count.alias("repetitions")).filter("repetitions > 0")
    copies = drawn.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repetitions"))).alias("copy"))
    order = F.md5(F.concat_ws("#", "id", "digest", F.col("copy").cast("string"), F.lit(f"order{seed}")))
    placed = copies.withColumn("mix_order", F.conv(F.substring(order, 1, 15), 16, 10).cast("long")).orderBy("mix_order", "copy")
    return placed.select("doc.*", "copy", "repetitions", "rate", "mix_order")
