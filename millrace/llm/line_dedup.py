"""Dropping lines that many documents share. DataFrame functions only.

Normalised lines are exploded as 128-bit hashes, once per document, and counted with map-side combining. The lines
of frequent hashes come back as (text digest, position) pairs, gathered as one position set per distinct text. Texts
move once, in the join that brings a document its dropped positions; the kept lines are put together by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.shared import ascii_lower, free_name, let, stored

SPACE = " \t\n\x0b\x0c\r"
BROADCAST_LINES = 100_000   # frequent hashes (16 bytes each) that may be broadcast; more are joined by a shuffle


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _hashes(text: Column, min_length: int) -> Column:
    """One hash per line in order; null for a key that is too short to be dropped."""
    def hashed(line: Column) -> Column:
        return let(line_key(line), lambda k: F.when(F.length(k) >= min_length, F.struct(
            F.xxhash64(k).alias("a"), F.xxhash64(k, F.lit(7)).alias("b"))))
    return F.transform(F.split(text, "\n"), hashed)


def frequent_lines(docs: DataFrame, text: Column, min_documents: int, min_length: int) -> DataFrame:
    """(a, b): the hashes of keys that at least ``min_documents`` rows hold."""
    once = docs.select(F.explode(F.array_distinct(_hashes(text, min_length))).alias("_h")).filter("_h is not null")
    return (once.select("_h.a", "_h.b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_documents).select("a", "b"))


def drop_frequent_lines(docs: DataFrame, text: str = "text", min_documents: int = 10, min_length: int = 1,
                        broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text added.

    Lines end at a line feed. A line whose key has at least ``min_length`` code points and is found in at least
    ``min_documents`` rows goes from every row; the others stay in their order. A null or empty text has one empty
    line, which stays. Every row is one document, also when rows are equal; other columns play no part. Input columns
    named like an added one are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    frequent = stored(frequent_lines(docs, whole, min_documents, min_length), "frequent-lines")
    small = frequent.count() <= broadcast_lines

    a, b, found = (free_name(docs.columns, c) for c in ("_a", "_b", "_found"))
    digest = [F.xxhash64(whole).alias(a), F.xxhash64(whole, F.lit(7)).alias(b)]  # equal texts lose the same positions
    lines = docs.select(*digest, F.posexplode(_hashes(whole, min_length)).alias("_pos", "_h")).filter("_h is not null")
    lines = lines.select(a, b, "_pos", F.col("_h.a").alias("_ha"), F.col("_h.b").alias("_hb"))
    wanted = frequent.select(F.col("a").alias("_ha"), F.col("b").alias("_hb"))
    hit = lines.join(F.broadcast(wanted) if small else wanted, ["_ha", "_hb"], "left_semi")
    dropped = stored(hit.groupBy(a, b).agg(F.collect_set("_pos").alias(found)), "dropped-positions")

    joined = docs.withColumns({a: digest[0], b: digest[1]}).join(dropped, [a, b], "left")
    parts = F.struct(F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("lines"),
                     F.coalesce(F.col(found), F.array().cast("array<int>")).alias("gone"))
    done = let(parts, lambda p: F.struct(
        F.size(p["lines"]).cast("long").alias("n_lines"), F.size(p["gone"]).cast("long").alias("n_dropped"),
        F.when(F.size(p["gone"]) == 0, F.array_join(p["lines"], "\n")).otherwise(F.array_join(F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(p["lines"]) - 1), p["gone"]), lambda i: F.get(p["lines"], i)), "\n"))
        .alias("kept_text")))
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    made = free_name(docs.columns, "_made")
    return joined.select(*keep, done.alias(made)).select(*keep, f"{made}.*")
