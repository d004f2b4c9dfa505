"""The registered queries of the corpus operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import (cover_tree, evidence_lang, external_shuffle, filter_potential, fm_decontam, line_dedup, maxent_lm, poisson_mix,
                          quality_votes, rans, simhash_index, url_filter, wrapper_html)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_rans_tokens")
def op1_rans_tokens(spark, sf):
    return rans.encode_documents(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


URL_RULES = [url_filter.Rule("com", "/", "allow"), url_filter.Rule("example.com", "/en/", "block"),
             url_filter.Rule("www.example.com", "/en/", "allow"), url_filter.Rule("net", "/es/", "block"),
             url_filter.Rule("net", "/fr/", "block")]


@query("op2_url_filter", r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 3), '') AS qs FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
                     || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical
      FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(qs, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&') AS q FROM p)),
listed AS (SELECT DISTINCT canonical AS l FROM c WHERE page_id % 20 = 0 AND canonical IS NOT NULL),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
         FROM c, rules WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id)
SELECT c.page_id, host, path, rule, canonical, l IS NOT NULL AS listed,
       coalesce(v, CASE WHEN l IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN best USING (page_id) LEFT JOIN listed ON c.canonical = l
""")
def op2_url_filter(spark, sf):
    """The tables hold no block list: the addresses of every twentieth page stand for one."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    listed = pages.filter("page_id % 20 = 0")
    return url_filter.filter_urls(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "canonical", "listed", "verdict")


@query("op3_maxent_lm")
def op3_maxent_lm(spark, sf):
    return maxent_lm.score_documents(table(spark, sf, "documents"), keep=["doc_id"])


@query("op4_simhash_index")
def op4_simhash_index(spark, sf):
    return simhash_index.near_duplicates(table(spark, sf, "documents"), keep=["doc_id"])


@query("op5_poisson_mix", """
WITH d AS (SELECT *, greatest(length(coalesce(text, '')), 1) AS u, coalesce('=' || source, '-') AS key FROM documents),
s AS (SELECT key, sum(u)::DOUBLE AS size FROM d GROUP BY 1),
r AS (SELECT key, sqrt(size) / sum(sqrt(size)) OVER () * sum(size) OVER () / size AS rate FROM s),
cdf AS (SELECT key, rate, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY key ORDER BY k) AS c
        FROM r, generate_series(0, 150) g(k)),
n AS (SELECT key, rate, doc_id, text, count(*) FILTER (WHERE c <= draw) AS repetitions
      FROM (SELECT doc_id, text, key, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '#' || md5(coalesce(text, '')) || '#1#1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS draw FROM d)
      JOIN cdf USING (key) GROUP BY ALL)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, copy, repetitions::BIGINT AS repetitions,
       ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || '#' || md5(coalesce(d.text, '')) || '#' || copy || '#order1'), 1, 15))::BIGINT AS mix_order
FROM d JOIN n USING (doc_id), generate_series(1, repetitions) g(copy)
""")
def op5_poisson_mix(spark, sf):
    return poisson_mix.mix_sources(table(spark, sf, "documents"), flatten=0.5).drop("rate")


@query("op6_fm_decontam")
def op6_fm_decontam(spark, sf):
    docs, benchmark = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")
    found = fm_decontam.find_contamination(docs, benchmark, keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


@query("op7_quality_votes")
def op7_quality_votes(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return quality_votes.judge_quality(docs, keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


@query("op8_line_dedup", r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
""")
def op8_line_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return (line_dedup.drop_frequent_lines(docs, min_documents=10, min_length=1)
            .select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")))


@query("op9_wrapper_html")
def op9_wrapper_html(spark, sf):
    return wrapper_html.extract(table(spark, sf, "pages"), keep=["page_id", "url"])


@query("op10_evidence_lang")
def op10_evidence_lang(spark, sf):
    """``lang`` is what a document declares, ``source`` where it comes from; documents have no address."""
    return evidence_lang.identify(table(spark, sf, "documents"), keep=["doc_id", "lang", "source"])


@query("op11_cover_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
""")
def op11_cover_negatives(spark, sf):
    """Every seventh label is wrong by one."""
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return cover_tree.hard_negatives(table(spark, sf, "embeddings"), noise=noisy)


@query("op12_filter_potential", r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT w.doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
             100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
             coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS e, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS tox
      FROM w LEFT JOIN labels l ON l.doc_id = w.doc_id),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE tox) AS tox FROM f GROUP BY ALL),
x(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.l || q.l || r.l || s.l || t.l AS filter_order FROM x p, x q, x r, x s, x t WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31),
k AS (SELECT filter_order, step::INTEGER AS step, x.bit AS own, coalesce((SELECT sum(y.bit) FROM x y WHERE instr(filter_order, y.l) < step), 0)::INT AS before
      FROM o, generate_series(1, 5) g(step) JOIN x ON x.l = substr(filter_order, step::INT, 1)),
parts AS (SELECT DISTINCT part FROM m),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
             sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN tox ELSE 0 END)::BIGINT AS toxic_lost
      FROM k, parts JOIN m USING (part) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
""")
def op12_filter_potential(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return filter_potential.audit_documents(docs, table(spark, sf, "labels"))


@query("op13_external_shuffle")
def op13_external_shuffle(spark, sf):
    """The law of equal row counts: there is no shard count with one more to compare with."""
    text = F.col("text")
    return external_shuffle.shard_documents(table(spark, sf, "documents")).select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
