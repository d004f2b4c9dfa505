"""Term weights per document as sparse tables (id, term, weight). Whole texts, built-in functions only.

The vocabulary is the ``size`` most frequent terms of the corpus (ties by term), so it is small by
construction and travels as a literal. Beyond the vocabulary's counts everything is an array expression per text: no
token becomes a row of its own, and no text is shuffled. Pairs are built only of words that can be in it. Each row is a document, also where keys repeat.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import text as T


def with_terms(df: DataFrame, key: str, text_col: str, ngrams: int = 1) -> DataFrame:
    """(key, terms): lower-cased tokens of two or more letters; with ``ngrams=2`` also adjacent pairs."""
    w = F.col("terms")
    out = df.select(key, T.words(text_col, T.WORD2).alias("terms"))
    return out if ngrams == 1 else out.select(key, F.concat(w, _pairs(w)).alias("terms"))


def _pairs(w: Column, met=None) -> Column:
    """Adjacent pairs of an array of words, joined by a space; of those only that ``met`` (first, second) holds for."""
    rest = F.greatest(F.size(w) - 1, F.lit(0))
    joined = lambda a, b: F.concat_ws(" ", a, b)
    pairs = F.zip_with(F.slice(w, 1, rest), F.slice(w, 2, rest), lambda a, b: F.when(met(a, b), joined(a, b)) if met else joined(a, b))
    return F.array_compact(pairs) if met else pairs


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once per row: a lambda's variable is never inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(items: Column) -> Column:
    """array<struct<term, tf>> of an array's distinct items with their numbers, in ascending order: sort, then cut where a new item begins."""
    def counted(s: Column) -> Column:
        size = F.size(s)
        places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return _let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), size) - i).cast("long").alias("tf"))))

    return _let(F.array_sort(items), counted)


def _counted(df: DataFrame, key: str, text_col: str, vocabulary: list[str], ngrams: int) -> DataFrame:
    """(key, runs): the vocabulary's terms in each text with their numbers."""
    known = lambda terms: F.filter(terms, lambda t: t.isin(vocabulary)) if vocabulary else F.array().cast("array<string>")
    found, pairs = known("terms"), [t.split(" ") for t in vocabulary if " " in t]
    if ngrams != 1 and pairs:
        firsts, seconds = sorted({p[0] for p in pairs}), sorted({p[-1] for p in pairs})
        found = F.concat(found, known(_pairs(F.col("terms"), lambda a, b: a.isin(firsts) & b.isin(seconds))))
    return with_terms(df, key, text_col).select(key, _runs(found).alias("runs"))


def term_counts(df: DataFrame, key: str, text_col: str, vocabulary: list[str], ngrams: int = 1) -> DataFrame:
    """(key, term, tf) over a fitted vocabulary, one row per row of ``df`` and term: texts are counted where they lie, nothing is shuffled."""
    return _counted(df, key, text_col, vocabulary, ngrams).select(key, F.inline("runs"))


def _frequent(terms: DataFrame, size: int) -> dict[str, int]:
    """The ``size`` most frequent items of the arrays ``terms`` with the number of arrays each occurs in, in one scan."""
    t = F.col("terms")
    hits = F.concat(F.transform(t, lambda x: F.struct(x.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df"))),
                    F.transform(F.array_distinct(t), lambda x: F.struct(x.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df"))))
    rows = (terms.select(F.explode(hits).alias("h")).groupBy("h.term").agg(F.sum("h.tf").alias("n"), F.sum("h.df").alias("docs"))
            .orderBy(F.desc("n"), "term").limit(size).collect())
    return {r["term"]: r["docs"] for r in rows}


SECONDS = 10   # times ``size``: words that travel as a literal


def fit_vocabulary(df: DataFrame, key: str, text_col: str, size: int, ngrams: int = 1) -> dict[str, int]:
    """The ``size`` most frequent terms with the number of documents each occurs in.

    A pair is no more frequent than either of its words and sorts behind its first. So of all pairs only those can be
    among the terms whose first word is one of the ``size`` most frequent words, and whose second is as frequent as the
    last of these. Words are counted first, then these words and pairs: the table of all pairs is never built.
    """
    words = with_terms(df, key, text_col).select("terms")
    if ngrams == 1:
        return _frequent(words, size)
    most = (words.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "term").limit(SECONDS * size + 1).collect())
    firsts = [r["term"] for r in most[:size]]
    if not firsts:
        return {}
    seconds = [r["term"] for r in most if r["n"] >= most[len(firsts) - 1]["n"]]
    if len(seconds) > SECONDS * size:   # so many are as frequent as the last: any second word
        met = lambda a, b: a.isin(firsts)
    else:
        met = lambda a, b: a.isin(firsts) & b.isin(seconds)
    able = F.concat(F.filter("terms", lambda t: t.isin(firsts)), _pairs(F.col("terms"), met))
    return _frequent(words.select(able.alias("terms")), size)


def bag_of_words(df: DataFrame, key: str, text_col: str, size: int = 100) -> DataFrame:
    return term_counts(df, key, text_col, list(fit_vocabulary(df, key, text_col, size)))


def _unit(weighted: Column) -> Column:
    """Weights divided by their L2 norm; ``weighted`` is an array of structs whose second field is ``weight``."""
    def scaled(w: Column) -> Column:
        norm = F.sqrt(F.aggregate(w, F.lit(0.0), lambda total, x: total + x["weight"] * x["weight"]))
        return _let(norm, lambda n: F.transform(w, lambda x: x.withField("weight", x["weight"] / n)))

    return _let(weighted, scaled)


def fit_tfidf(df: DataFrame, key: str, text_col: str, size: int, ngrams: int = 1) -> dict[str, float]:
    """idf = ln((1 + documents) / (1 + documents with the term)) + 1 for the vocabulary."""
    vocab = fit_vocabulary(df, key, text_col, size, ngrams)
    n = df.count()
    return {term: math.log((1.0 + n) / (1.0 + docs)) + 1.0 for term, docs in vocab.items()}


def apply_tfidf(df: DataFrame, key: str, text_col: str, idf: dict[str, float], ngrams: int = 1) -> DataFrame:
    """(key, term, weight) in one pass over the texts, without a shuffle."""
    terms = sorted(idf)
    if not terms:
        return df.select(key, F.lit("").alias("term"), F.lit(0.0).alias("weight")).filter(F.lit(False))
    names, weights = F.array(*[F.lit(t) for t in terms]), F.array(*[F.lit(idf[t]) for t in terms])
    of = lambda x: F.get(weights, (F.array_position(names, x["term"]) - 1).cast("int"))
    weighted = F.transform("runs", lambda x: F.struct(x["term"].alias("term"), (x["tf"] * of(x)).alias("weight")))
    return _counted(df, key, text_col, terms, ngrams).select(key, F.inline(_unit(weighted)))


def tfidf(df: DataFrame, key: str, text_col: str, size: int = 50, ngrams: int = 1) -> DataFrame:
    return apply_tfidf(df, key, text_col, fit_tfidf(df, key, text_col, size, ngrams), ngrams)


def hashing_vector(df: DataFrame, key: str, text_col: str, features: int = 64) -> DataFrame:
    """(key, bucket, weight): md5 bucket counts with unit length per document. Nothing to fit."""
    buckets = F.transform("terms", lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % features)
    counted = with_terms(df, key, text_col).select(key, _runs(buckets).alias("runs"))
    weighted = F.transform("runs", lambda x: F.struct(x["term"].alias("bucket"), x["tf"].cast("double").alias("weight")))
    return counted.select(key, F.inline(_unit(weighted)))
