"""The registered corpus queries: against DuckDB where SQL says them, else against brute force."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from check_queries import TABLES, compare
from millrace.llm.queries import ORACLE, QUERIES
from tests.llm import brute


@pytest.fixture(scope="module")
def rows(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert compare(QUERIES[name](spark, sf), con, ORACLE[name]).startswith("ok")


def test_registered():
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLE) <= set(entry_module.oracle_sql())


def by_id(df, *columns):
    found = df.select("doc_id", *columns).collect()
    out = {r[0]: tuple(r[1:]) for r in found}
    assert len(out) == len(found)
    return out


def test_op1(spark, sf, rows):
    assert by_id(QUERIES["op1_rans_tokens"](spark, sf), "start", "n_tokens", "ids_crc32") == brute.encoded(rows)


def test_op4(spark, sf, rows):
    assert by_id(QUERIES["op4_simhash_index"](spark, sf), "fingerprint", "component_id") == brute.components(rows)


def test_op6(spark, sf, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = by_id(QUERIES["op6_fm_decontam"](spark, sf), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.contamination(rows, items) and any(v[-1] for v in got.values())


def test_op7(spark, sf, rows):
    got = by_id(QUERIES["op7_quality_votes"](spark, sf), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {d: brute.quality_counts(t) for d, t in rows}


def test_op3(spark, sf, rows):
    got = by_id(QUERIES["op3_maxent_lm"](spark, sf), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = brute.language_model_base(rows)
    assert {d: v[:4] for d, v in got.items()} == {d: v[:4] for d, v in want.items()}
    assert all(abs(got[d][4] - want[d][4]) < 1e-6 * abs(want[d][4]) for d in want)
    for held in (False, True):   # it beats the counts, on documents that it has not seen too
        assert sum(v[5] for v in got.values() if v[0] is held) > sum(v[4] for v in got.values() if v[0] is held)


def test_op9(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in QUERIES["op9_wrapper_html"](spark, sf).collect()}
    assert got.keys() == pages.keys()
    assert all(got[i].text == brute.article(h) and got[i].n_chars == len(got[i].text) for i, h in pages.items())


def test_op10(spark, sf, rows):
    got = by_id(QUERIES["op10_evidence_lang"](spark, sf), "lang", "language", "accepted")
    assert got.keys() == {d for d, _ in rows}
    assert sum(lang == found and ok for lang, found, ok in got.values()) >= 0.99 * len(got)


def test_pipeline(spark, sf):
    import corpus_pipeline

    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    assert len(kept) >= 0.99 * len(rows)
    first = {c for _, c in brute.components([(r.doc_id, r.text) for r in rows if r.doc_id in kept]).values()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = brute.contamination([(r.doc_id, r.text) for r in rows if r.doc_id in first], items)
    clean = [r for r in rows if r.doc_id in first and not dirty[r.doc_id][-1]]
    assert len(clean) < len(first) < len(kept)
    times = brute.copies([(r.doc_id, r.text, r.source) for r in clean])
    ids = dict(zip([r.doc_id for r in clean], brute.token_ids([r.text for r in clean])))
    got = corpus_pipeline.run(spark, sf).orderBy("start").collect()
    from collections import Counter
    assert Counter(r.doc_id for r in got) == Counter({d: k for d, k in times.items() if k})
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(ids[r.doc_id]))
        at += r.n_tokens
