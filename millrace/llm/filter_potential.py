"""How quality filters interact: the removal game's Hart-Mas-Colell potential over all coalitions of filters.

A coalition of filters removes the documents that fail one of its members; v(S) is their number. The potential is
P(S) = (v(S) + sum of P(S without i) over i in S) / |S|, and a filter's Shapley value is P(all) - P(all without it).
What a filter removes as the next one after the filters in S is v(S with it) - v(S). So one scan that counts documents by the set
of filters that they fail answers for every order; nothing is filtered 120 times.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.shared import stored

WHITE = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """The four conditions that a text alone decides, by letter. Null is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, WHITE), "")
    n_words = F.size(words)
    return {
        "A": n_words < 200,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < n_words.cast("long") * 50,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * 3,
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_counts(docs: DataFrame, labels: DataFrame, failures: dict[str, Column], repeat: str = "E", id_col: str = "doc_id",
                   text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and set of failed filters, bit k for the k-th of ``failures`` and the last
    bit for ``repeat``: a text that a smaller id has too.

    The conditions in ``failures`` must depend on the text alone. A group of equal texts is one row per part and labels before it
    is shuffled by text, however many copies it has. Null texts are empty texts. A null part is the empty string. Rows with a null
    id neither are nor have a smaller id and carry no label. Repeated label rows count once: quality or toxic is 1 if one says so.
    """
    mask = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(failures.values())), F.lit(0))
    whole = F.coalesce(F.col(text), F.lit(""))
    # equal rows meet here, combined on the map side
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(whole, 256)).alias("digest"), mask.alias("mask"))
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    flags = (labels.groupBy(F.col(id_col).alias("id")).agg(F.max(F.coalesce(F.col("quality"), F.lit(0)) == 1).alias("good"),
                                                           F.max(F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("toxic")).filter("id IS NOT NULL"))
    named = rows.filter("id IS NOT NULL").join(flags, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # a text's first document, and all others with the same labels and part: at most four rows per text and part
    cells = named.groupBy("digest", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    least = cells.groupBy("digest", "mask").agg(F.min("first.id").alias("least"), F.collect_list(F.struct("part", "good", "toxic", "n", "first")).alias("cells"))
    cell = least.select("mask", "least", F.inline("cells"))
    firsts = F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    bit = 1 << len(failures)
    split = cell.select("part", "good", "toxic", F.inline(F.array(F.struct(F.col("mask").alias("mask"), firsts.alias("n")),
                                                                  F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - firsts).alias("n")))))
    nameless = rows.filter("id IS NULL").select("part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "mask", "n")
    every = split.unionByName(nameless).filter("n > 0")
    share = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0)))
    return every.groupBy("part", "mask").agg(F.sum("n").alias("n"), share("good").alias("good"), share("toxic").alias("toxic"))


def _removed(counts: Column, coalitions: int) -> Column:
    """v(S) for each coalition S: the documents whose failed filters meet S."""
    sets = F.sequence(F.lit(0), F.lit(coalitions - 1))
    return F.transform(sets, lambda s: F.aggregate(sets, F.lit(0).cast("long"), lambda total, m: total + F.when(m.bitwiseAND(s) != 0, F.get(counts, m)).otherwise(F.lit(0).cast("long"))))


def _potential(removed: Column, players: int) -> Column:
    """players! times the potential of each coalition, in whole numbers: a coalition's subsets come before it."""
    scale = factorial(players)

    def step(known, s):
        without = [F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(known, s - F.lit(1 << i))).otherwise(F.lit(0).cast("long")) for i in range(players)]
        total = sum(without, F.get(removed, s) * scale)
        return F.concat(known, F.array(F.call_function("div", total, F.bit_count(s).cast("long"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << players) - 1)), F.array(F.lit(0).cast("long")), step)


def audit(counts: DataFrame, filters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): one row per part, order
    of the filters (one letter each) and step. ``shapley`` is summed over all orders. No parts, no rows."""
    players, every = len(filters), (1 << len(filters)) - 1
    if not 1 <= players <= 6:
        raise ValueError("one to six filters: all their orders are listed")
    cell = lambda c, m: F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(F.lit(0)))
    held = counts.groupBy("part").agg(*[F.array(*[cell(c, m) for m in range(every + 1)]).alias(c) for c in ("n", "good", "toxic")])
    game = held.select("part", F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"),
                       *[_removed(F.col(c), every + 1).alias(c) for c in ("n", "good", "toxic")])
    game = stored(game.withColumn("potential", _potential(F.col("n"), players)), "removal-games")   # one row per part
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    steps = game.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(players))).alias("step"))
    at = lambda k: F.call_function("substring", F.col("filter_order"), k, F.lit(1))
    bits = F.transform(F.sequence(F.lit(1), F.col("step")), lambda k: F.call_function("shiftleft", F.lit(1), F.call_function("locate", at(k), F.lit(filters)) - 1))
    steps = (steps.withColumn("own", F.element_at(bits, -1))
             .withColumn("before", F.aggregate(bits, F.lit(0), lambda a, b: a + b) - F.col("own")))
    value = lambda c, s: F.get(F.col(c), s)
    own, before, after, rest = F.col("own"), F.col("before"), F.col("before") + F.col("own"), F.lit(every) - F.col("own")
    removed = value("n", after) - value("n", before)
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), (F.col("total") - value("n", after)).alias("kept"), removed.alias("removed"),
        (value("n", own) - removed).alias("redundant"), (value("n", F.lit(every)) - value("n", rest)).alias("unique_fails"),
        (value("good", after) - value("good", before)).alias("good_lost"), (value("toxic", after) - value("toxic", before)).alias("toxic_lost"),
        (value("potential", F.lit(every)) - value("potential", rest)).alias("shapley"))


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The audit of the five filters A to E over ``docs``: the four text conditions and repeats."""
    failures = text_failures(F.col(text))
    return audit(failure_counts(docs, labels, failures, "E", id_col, text, part), "".join(failures) + "E")
