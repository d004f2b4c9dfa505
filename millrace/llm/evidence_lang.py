"""Language identification by fusing evidence in Bayes' rule.

Three pieces of evidence meet for a document: how likely its letters are in each language (byte trigrams, counted over
all documents that declare it), the language that its markup or metadata declares (with the reliability that
declarations are found to have), and where it comes from: a prior per host that is smoothed by the prior of the
host's address suffix, which is smoothed by the prior of the corpus. 'und', no language at all, is a candidate whose
letters are equally likely everywhere. Every declared language is a candidate. The ``MODELLED`` most declared have a model of their own;
for the others, of which a corpus of real languages has few, letters are as likely as for 'und'.

The three tables come from grouped aggregations over all documents, combined on the map side; trigram counts and the
reliability of declarations have a size that does not grow with the corpus, the host table is joined (hot hosts apart).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from millrace.llm.shared import returning, slices, small_batches, stored
from millrace.llm.url_filter import host_of, path_of
from millrace.plans.lookup import fit_lookup, join_lookup

BUCKETS = 1 << 16
UNKNOWN = "und"
MODELLED = 128            # languages with a model of their letters: bounds the table, whatever is declared
FEW = 3                   # documents at which half of a model comes from their letters and half is even
TEMPER = 1 / 3            # overlapping trigrams: a third of them would say the same
EVEN = 0.2                # share of a language's letters that its model deals out evenly, so that new words don't make a text 'und'
SURE = 20                 # trigrams from which a text alone may speak for its host and its declaration

#: letters A-Z in lower case, everything beyond ASCII as it is, all else a space
_LETTERS = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams around each letter of all texts, and how many each text has."""
    raw = [(" " + t.lower() + " ").encode("utf-8", "surrogatepass").translate(_LETTERS) if t else b"  " for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    mid = b[1:-1] if len(b) > 2 else b[:0]
    code = (b[:-2] | mid << 8 | b[2:] << 16) if len(mid) else mid
    bucket = (code * np.uint32(2654435761)) >> np.uint32(16)
    letter = mid != 32
    ends = np.cumsum(size)
    count = np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(letter)])[np.minimum(np.maximum(ends - 1, 0), len(letter))]])) if len(raw) else np.zeros(0, np.int64)
    return bucket[letter].astype(np.int64), count


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order and the log likelihood of each bucket: one row per bucket, 'und' last."""
    languages: tuple[str, ...]
    table: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log likelihoods (texts × languages and und) and the number of trigrams."""
        bucket, count = trigrams(texts)
        ends = np.cumsum(count)
        out = np.zeros((len(texts), self.table.shape[1]))
        if len(bucket):
            full = count > 0
            sums = np.empty((int(full.sum()), out.shape[1]))
            begin = (ends - count)[full]
            for k in range(out.shape[1] - 1):
                sums[:, k] = np.add.reduceat(self.table[:, k][bucket], begin)
            sums[:, -1] = count[full] * self.table[0, -1]
            out[full] = sums * TEMPER
        return out, count


def text_model(docs: DataFrame, text: str, declared: str) -> LanguageModel:
    """Trigram counts of all documents by their declared language."""
    said = docs.filter(F.col(declared).isNotNull() & (F.col(declared) != UNKNOWN)).groupBy(declared).agg(F.count(F.lit(1)).alias("n"))
    documents = {r[0]: r[1] for r in said.orderBy(F.desc("n"), declared).limit(MODELLED).collect()}
    languages = tuple(sorted(documents))
    index = {c: i for i, c in enumerate(languages)}

    def count(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in slices(batches, text):
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for c in index.keys() & set(names):
                bucket, _ = trigrams([t for t, d in zip(texts, names) if d == c])
                sums[index[c]] = sums.get(index[c], 0) + np.bincount(bucket, minlength=BUCKETS)
        for i, row in sums.items():
            j = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), i)), pa.array(j), pa.array(row[j])], names=["lang", "bucket", "n"])

    counts = docs.select(text, declared).mapInArrow(returning(count), "lang long, bucket long, n long")
    sums = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()   # at most languages × BUCKETS rows
    table = np.zeros((BUCKETS, len(languages) + 1))
    table[sums.bucket.to_numpy(), sums.lang.to_numpy()] = sums.n.to_numpy()
    d = np.array([*(documents[c] for c in languages), 0.0]) ** 2
    own = (1 - EVEN) * d / (d + FEW ** 2)   # one wrong declaration must not model its own text
    table = own * (table / np.maximum(table.sum(0), 1)) + (1 - own) / BUCKETS
    table[:, -1] = 1 / BUCKETS
    return LanguageModel(languages, np.log(table))


def address_suffix(address: Column) -> Column:
    """The last label of the host and, if the path begins with one, a two-letter segment: ``net/fr``."""
    host, segment = host_of(address), F.regexp_extract(path_of(address), "^/([a-zA-Z]{2})(/|$)", 1)
    return F.concat_ws("/", F.regexp_extract(host, r"([^.]*)$", 1), F.when(segment != "", F.lower(segment)))


def markup_language(html: Column) -> Column:
    """The primary subtag of the language that the html element declares, or null."""
    found = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z]+)""", 1))
    return F.when(found != "", found)


def _smoothed(counts: list[Column], total: Column, parent: list[Column], mass: float) -> list[Column]:
    return [(c + F.lit(mass) * p) / (total + mass) for c, p in zip(counts, parent)]


def identify(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source", address: str | None = None,
             keep: list[str] | None = None, least: float = 0.5, accept: list[str] | None = None, mass: float = 20.0) -> DataFrame:
    """Columns ``keep`` (all by default) with language, confidence and accepted.

    ``host`` names the column of hosts; with ``address`` host and suffix are read from that column of urls instead.
    Accepted: the text has letters, the best candidate is a language (one of ``accept`` if given) and its posterior
    is at least ``least``. Null and empty texts have no letters: their language rests on the other evidence and they
    are not accepted. A null declaration, host or address is no evidence. A document of even letters
    that declares a language without a model is in that language. Equal rows get equal results; without any declaration all is 'und'. Input columns named
    like an added one are replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("language", "confidence", "accepted")]
    origin = F.col(host).cast("string") if address is None else F.when(host_of(F.col(address)) != "", host_of(F.col(address)))
    suffix = F.lit("") if address is None else F.coalesce(address_suffix(F.col(address)), F.lit(""))
    frame = small_batches(docs).select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(names)], F.col(text).alias("_text"), F.col(declared).cast("string").alias("_said"),
                        F.coalesce(origin, F.lit("")).alias("_host"), suffix.alias("_suffix"))
    model = text_model(frame, "_text", "_said")
    classes = [*model.languages, UNKNOWN]
    shared = docs.sparkSession.sparkContext.broadcast(model)   # languages × BUCKETS numbers

    def score(batches):
        for batch in slices(batches, "_text"):
            ll, n = shared.value.score(batch.column("_text").to_pylist())
            rest = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(list(ll), pa.list_(pa.float64())), pa.array(n, pa.int64())], names=[*rest, "_ll", "_n"])

    def scored(columns):
        chosen = frame.select(*columns, "_text")
        fields = [f for f in chosen.schema.fields if f.name != "_text"]
        return chosen.mapInArrow(returning(score), StructType(fields).add("_ll", ArrayType(DoubleType())).add("_n", LongType()))

    # what texts that speak for themselves say about declarations and places
    best = F.array_position(F.col("_ll"), F.array_max("_ll")) - 1
    said = F.array_position(F.array(*map(F.lit, classes)), F.coalesce("_said", F.lit(""))) - 1   # -1: none, or none that is modelled
    sure = (scored(["_said", "_host", "_suffix"]).filter(F.col("_n") >= SURE)
            .groupBy("_host", "_suffix", said.alias("_d"), best.alias("_best")).agg(F.count(F.lit(1)).alias("n")))
    sure = stored(sure, "language-counts")
    k = len(classes)
    pairs = np.full((k + 1, k), 0.5)
    pairs[np.arange(k), np.arange(k)] = 2.0
    for r in sure.groupBy("_d", "_best").agg(F.sum("n").alias("n")).collect():   # at most (k + 1) × k rows
        pairs[r["_d"], r["_best"]] += r.n
    declare = np.log(pairs / pairs.sum(0))                                       # log P(declaration | language)
    overall = pairs.sum(0) / pairs.sum()
    columns = [f"c{i}" for i in range(k)]
    tally = [F.sum(F.when(F.col("_best") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(columns)]
    by_suffix = sure.groupBy("_suffix").agg(*tally, F.sum("n").alias("n"))
    top = by_suffix.select("_suffix", *[p.alias(f"p{i}") for i, p in enumerate(_smoothed([F.col(c) for c in columns], F.col("n"), [F.lit(float(x)) for x in overall], mass))])
    by_host = sure.groupBy("_host", "_suffix").agg(*tally, F.sum("n").alias("n")).join(top, "_suffix")
    near = _smoothed([F.col(c) for c in columns], F.col("n"), [F.col(f"p{i}") for i in range(k)], mass)
    places = by_host.select(F.concat_ws("\n", "_host", "_suffix").alias("place"), "n", F.array(*[F.ln(p) for p in near]).alias("prior"))

    out = scored([*[f"in_{i}" for i in range(len(names))], "_said", "_host", "_suffix"]).withColumn("place", F.concat_ws("\n", "_host", "_suffix"))
    out = join_lookup(out, fit_lookup(places, ["place"]), ["prior"])
    prior = F.coalesce("prior", F.array(*[F.lit(math.log(x)) for x in overall]))
    rows = docs.sparkSession.createDataFrame([(d if d < k else -1, [float(x) for x in row]) for d, row in enumerate(declare)], "_d int, _declare array<double>")
    out = out.withColumn("_d", said.cast("int")).join(F.broadcast(rows), "_d")   # k + 1 rows
    fused = F.zip_with(F.zip_with(F.col("_ll"), prior, lambda a, b: a + b), F.col("_declare"), lambda a, b: a + b)
    out = out.withColumn("_post", fused).withColumn("_top", F.array_max("_post"))
    out = out.withColumn("_sum", F.aggregate(F.transform("_post", lambda x: F.exp(x - F.col("_top"))), F.lit(0.0), lambda a, x: a + x))
    language = F.get(F.array(*map(F.lit, classes)), (F.array_position(F.col("_post"), F.col("_top")) - 1).cast("int"))
    unmodelled = (F.col("_said") != UNKNOWN) & (F.col("_d") < 0) & (F.col("_n") > 0)
    language = F.when((language == UNKNOWN) & unmodelled, F.col("_said")).otherwise(language)
    out = out.withColumns({"language": language, "confidence": 1 / F.col("_sum")})
    good = (F.col("_n") > 0) & (F.col("language") != UNKNOWN) & (F.col("confidence") >= least)
    if accept is not None:
        good = good & F.col("language").isin(accept)
    return out.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(names)], "language", "confidence", good.alias("accepted"))
