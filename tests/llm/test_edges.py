"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, operator by operator."""

import cProfile
import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import (evidence_lang, fm_decontam, line_dedup, maxent_lm, poisson_mix, quality_votes, rans, simhash_index,
                          url_filter, wrapper_html)
from tests.llm import brute

LONG = " ".join(f"word{i % 997} tail{i}" for i in range(60_000))
TEXT = "The quick brown fox jumps over the lazy dog while nine other animals look on from the shade of a tree."
ROWS = [(1, TEXT), (2, TEXT), (2, TEXT), (3, None), (4, ""), (None, "a line\nof text"), (5, LONG), (6, " \t\n "), (7, "x"),
        (8, "café über 한국어 \U0001f600  two  spaces\r\n\x0b tab\t end ")]
CLASH = "key id row n_words n host place fp digest rate tail lines score copy label spans verdict votes text_ _text in_0 _a block w0 doc page".split()


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame([(i, t, "en" if i and i % 2 else None, "s" if i != 4 else None) for i, t in ROWS], "doc_id long, text string, lang string, source string")
    return frame.withColumns({c: F.lit("kept") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id = -1")


def check_columns(out, docs, added):
    """Clashing columns that the operator does not add come through as they were."""
    for c in docs.columns:
        if c not in added:
            assert out.schema[c].dataType == docs.schema[c].dataType
    left = [c for c in CLASH if c not in added]
    assert out.filter(" or ".join(f"{c} <> 'kept'" for c in left)).count() == 0


def test_tokens(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = rans.encode_documents(docs, path, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i or 0))
    want = sorted((i if i is not None else -1, tuple(ids)) for (i, _), ids in zip(ROWS, brute.token_ids([t for _, t in ROWS])))
    got = [(r.doc_id if r.doc_id is not None else -1, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in out]
    assert sorted(got) == want
    at = 0
    for r in out:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(r.ids))
        at += r.n_tokens
    assert rans.encode_documents(empty, path).count() == 0


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0, np.uint32), np.zeros(5000, np.uint32), rng.integers(0, 3, 100_001).astype(np.uint32), (rng.zipf(1.3, 70_000) % 50_000).astype(np.uint32)):
        seen, n = np.unique(ids, return_counts=True)
        freq = rans.scaled_frequencies(seen.astype(np.int64), n, int(seen.max()) + 1 if len(seen) else 1)
        cum, slots = rans.slot_table(freq)
        lanes, states, words = rans.encode_block(ids, freq, cum)
        assert (rans.decode_block(len(ids), lanes, states, words, freq, cum, slots) == ids).all()
        if len(words):
            words = words.copy()
            words[len(words) // 2] ^= 1
            with pytest.raises((ValueError, IndexError)):
                if (rans.decode_block(len(ids), lanes, states, words, freq, cum, slots) != ids).any():
                    raise ValueError


def test_url_filter(spark, docs):
    urls = [None, "", "no address", "http://A.Example.com/en/x?b=1&a=2#f", "https://www.example.com/en/", "ftp://x.net/es/", "http://x.net", "http://h.org/p/?utm_a=1&z=2",
            "http://www.h.org/p?z=2", "http://h.org/p?z=3", "http://h.org/p?z=3"]
    pages = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)], "page_id long, url string, block string")
    listed = spark.createDataFrame([("https://h.org/p?z=2",), ("https://h.org/p?z=2",), (None,)], "url string")
    rules = [url_filter.Rule("com", "/", "allow"), url_filter.Rule("example.com", "/en/", "block"), url_filter.Rule("www.example.com", "/en/", "allow"), url_filter.Rule("net", "/es/", "block")]
    for blocks in (url_filter.MAX_BLOCKS, 1):
        out = {r.page_id: r for r in url_filter.filter_urls(pages, listed, rules, max_blocks=blocks).collect()}
        assert [(out[i].host, out[i].path, out[i].rule, out[i].verdict) for i in range(len(urls))] == [
            ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "/en/x", "example.com/en/", "block"),
            ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("x.net", "/es/", "net/es/", "block"), ("x.net", "", None, "allow"),
            ("h.org", "/p/", None, "block"), ("www.h.org", "/p", None, "block"), ("h.org", "/p", None, "allow"), ("h.org", "/p", None, "allow")]
        assert out[0].block == "kept"
    assert url_filter.filter_urls(pages, listed.limit(0), []).filter("verdict = 'block'").count() == 0
    assert url_filter.filter_urls(pages.limit(0), listed, rules).count() == 0


def test_language_model(docs, empty):
    out = maxent_lm.score_documents(docs, shares=(0.5, 0.5))
    check_columns(out, docs, {"held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"})
    rows = out.collect()
    words = lambda t: brute.SPACED.findall((t or "").translate(brute.LOWER))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    seen = {}
    for i, t in ROWS:
        if not held(i):
            for w in [*words(t), None]:
                seen[w] = seen.get(w, 0) + 1
    n = sum(seen.values())
    got = sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert got == sorted((i or -1, held(i), len(words(t)) + 1, sum(w in seen for w in [*words(t), None]), n, round(sum(
        np.log10((seen.get(w, 0) + 0.1) / (n + 0.1 * (len(seen) + 1))) for w in [*words(t), None]), 6)) for i, t in ROWS)
    assert all(r.score < 0 for r in rows)
    assert maxent_lm.score_documents(empty).count() == 0


def test_language_model_sums_to_one():
    """Over all classes, words and unknown words, after training steps, the probabilities add up to one."""
    words = [b"w%d" % i for i in range(700)]
    counts = np.arange(700, 0, -1)
    totals, kinds = np.zeros(32), np.zeros(32)
    for w, c in zip(words[512:], counts[512:]):
        totals[maxent_lm.shape(w)] += c
        kinds[maxent_lm.shape(w)] += 1
    v = maxent_lm.Vocabulary(int(counts.sum()), 700, words, counts, totals, kinds)
    codes, w = maxent_lm.Codes(words), maxent_lm.Weights()
    rng = np.random.default_rng(1)
    flat = rng.integers(0, 700, 3000)
    stream = maxent_lm.Stream(flat, np.array([3000]), v)
    state = {"outer_n": np.zeros(len(w.outer), np.int64), "inner_n": np.zeros(len(w.inner), np.int64)}
    before = maxent_lm.log10_parts(w, stream, v).sum()
    maxent_lm.train_batch(w, state, stream, v)
    assert maxent_lm.log10_parts(w, stream, v).sum() > before
    history = flat[:3].tolist()
    total = 0.0
    for code in range(700):
        s = maxent_lm.Stream(np.array([*history, code]), np.array([4]), v)
        total += 10 ** maxent_lm.log10_parts(w, s, v)[-1]
    for cls in range(16, 32):
        s = maxent_lm.Stream(np.array([*history, maxent_lm.HEAD + cls * maxent_lm.TAIL]), np.array([4]), v)
        total += 10 ** maxent_lm.log10_parts(w, s, v)[-1] * maxent_lm.DELTA / v.room[cls]
    assert abs(total - 1) < 1e-4 and codes[b"w3"] == 3


def test_language_model_step_is_the_gradient_of_the_likelihood():
    """One step of one batch, against gradients summed row by row."""
    rng = np.random.default_rng(2)
    weights, bias = rng.normal(size=(40, 32)).astype(np.float32), rng.normal(size=32).astype(np.float32)
    features, target = [rng.integers(0, 40, 500), rng.integers(0, 40, 500)], rng.integers(0, 32, 500)
    want = weights.astype(float)
    z = want[features[0]] + want[features[1]] + bias
    z = np.exp(z) / np.exp(z).sum(1, keepdims=True) - np.eye(32)[target]
    seen, squares = np.zeros(40), np.zeros(40)
    for f in features:
        g = np.zeros((40, 32))
        np.add.at(g, f, z)
        np.add.at(seen, f, 1)
        squares += (g * g).sum(1)
        want -= maxent_lm.RATE * g / (np.sqrt(squares) + 1e-6)[:, None]
    got, squares_got, seen_got = weights.copy(), np.zeros(40), np.zeros(40, np.int64)
    maxent_lm._step(got, squares_got, seen_got, features, target, bias)
    assert np.allclose(got, want, atol=1e-4) and np.allclose(squares_got, squares, rtol=1e-4) and (seen_got == seen).all()


def test_language_model_learns_from_all_tasks(spark):
    """Eight tasks keep most of what one learns; the mean of their changes alone kept half."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    gains = []
    for frame in (docs.coalesce(1), docs.repartition(8, "doc_id")):
        out = maxent_lm.score_documents(frame).filter("held_out").selectExpr("sum(score - base_score) / sum(n_tokens)")
        gains.append(out.first()[0])
    assert gains[0] > 0 and gains[1] >= 0.8 * gains[0]


def test_language_model_splits_whole_batches_as_it_would_each_text():
    """Words, counts of words, codes and groups, against the texts one by one; one Python call per word failed."""
    rng = np.random.default_rng(3)
    odd = [None, "", " ", "\n\t", "a", " A  b\x0b\x0c\r c ", "\x1c\x1d x\x85y", "É\u2003İ", "A\x00b c", "x" * 50, "ab abc zabc"]
    texts = odd + [" ".join(f"W{i}" for i in rng.integers(0, 10 ** 9, rng.integers(0, 400))) for _ in range(500)]
    want = [[w.encode() for w in brute.SPACED.findall((t or "").translate(brute.LOWER))] + [b""] for t in texts]
    flat = [w for ws in want for w in ws]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i:i + 7], pa.string())], names=["_text"]) for i in range(0, len(texts), 7)]
    words, sizes = maxent_lm.words_of(pa.array([None, "x", *texts], pa.string())[2:])
    assert words.to_pylist() == flat and sizes.tolist() == [len(ws) for ws in want]
    head = sorted(set(flat[:60]))
    v = maxent_lm.Vocabulary(len(flat), len(set(flat)), head, np.arange(len(head), 0, -1), np.ones(32), np.ones(32))
    code = {w: i for i, w in enumerate(head)}
    other = lambda w: maxent_lm.HEAD + maxent_lm.shape(w) * maxent_lm.TAIL + zlib.crc32(w) % maxent_lm.TAIL
    profile = cProfile.Profile()
    groups = profile.runcall(lambda: list(maxent_lm._streams(iter(batches), maxent_lm.Codes(head), v, tokens=4_500)))
    assert sum(e.callcount for e in profile.getstats()) < len(flat) / 4
    assert [w for g in groups for w in g[0].to_pylist()] == flat
    assert [c for g in groups for c in g[2].codes.tolist()] == [code.get(w, other(w)) for w in flat]
    begin = 0
    for k, (_, sizes, _) in enumerate(groups):   # a group ends with the document that fills it
        assert sizes.tolist() == [len(ws) for ws in want[begin:begin + len(sizes)]]
        assert sizes[:-1].sum() < 4_500 and (sizes.sum() >= 4_500 or k == len(groups) - 1)
        begin += len(sizes)
    assert begin == len(want) and len(groups) > 10 and list(maxent_lm._streams(iter([]), maxent_lm.Codes([]), v)) == []


def test_language_model_sums_rows_in_order():
    """Sums by row equal those of counting, to the last bit, for rows that occur once, several times and very often."""
    rng = np.random.default_rng(4)
    for f in (rng.zipf(1.3, 5000) % 40_000, np.zeros(300, np.int64), np.arange(200), np.repeat(np.arange(5), [1, maxent_lm.FEW - 1, maxent_lm.FEW, maxent_lm.FEW + 1, 500])):
        f, z = rng.permutation(f), rng.normal(size=(len(f), 32)).astype(np.float32).astype(np.float64)
        rows, often, sums = maxent_lm._row_sums(z, f)
        want = np.bincount((f[:, None] * 32 + np.arange(32)).ravel(), z.ravel(), 32 * (f.max() + 1)).reshape(-1, 32)
        assert sorted(zip(rows.tolist(), often.tolist())) == sorted(collections.Counter(f.tolist()).items())
        assert (sums == want[rows].astype(np.float32)).all()


def test_simhash(docs, empty):
    out = simhash_index.near_duplicates(docs)
    check_columns(out, docs, {"fingerprint", "component_id", "component_print"})
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in out.collect())
    least = {}
    for i, t in ROWS:
        f = f"{brute.fingerprint(t):016x}"
        least[f] = min([x for x in (i, least.get(f)) if x is not None], default=None)
    assert got == sorted((i or -1, (f := f"{brute.fingerprint(t):016x}"), least[f] or -1) for i, t in ROWS)
    assert simhash_index.near_duplicates(empty).count() == 0
    stay = sorted((r.doc_id or -1, r.text) for r in simhash_index.one_of_each(docs).select("doc_id", "text").collect())
    assert [i for i, _ in stay] == [-1, 1, 3, 5, 7, 8] and simhash_index.one_of_each(docs).columns == docs.columns


@pytest.mark.parametrize("limit", [2, 40, 512])
def test_dense_lists(spark, limit):
    """Fingerprints in a few tight clouds: lists of all sizes, refined down to the last level when the limit is small."""
    rng = np.random.default_rng(5)
    prints = set()
    for centre in rng.integers(0, 2 ** 62, 6):
        for _ in range(120):
            bits = rng.choice(24, rng.integers(0, 6), replace=False)
            prints.add(int(centre) ^ int(sum(1 << int(b) for b in bits)))
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    links = [(r.src, r.dst) for r in simhash_index.fingerprint_links(frame, limit=limit).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in links)
    want = {d: c for d, (_, c) in brute.components([], {p: p for p in prints}).items()}
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert {p: root(p) for p in prints} == want


def test_mixing(docs, empty):
    out = poisson_mix.mix_sources(docs, weights={"s": 1.0, None: 1e-7, "absent": 5.0}, total=20_000_000.0)
    check_columns(out, docs, {"copy", "repetitions", "rate", "mix_order"})
    rows = out.collect()
    twice = [r for r in rows if r.doc_id == 5]
    assert len({r.repetitions for r in twice}) == 1 and len(twice) == twice[0].repetitions and all(1 <= r.copy <= r.repetitions for r in rows)
    assert poisson_mix.mix_sources(empty).count() == 0 and poisson_mix.mix_sources(docs, weights={}).count() == 0
    order = [r.mix_order for r in rows]
    assert order == sorted(order)


def test_mixing_rates(spark):
    """The mean number of copies is the rate, also where it takes several draws."""
    frame = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"))
    mean = {r.source: r.n / 2000 for r in poisson_mix.mix_sources(frame, {"a": 1, "b": 99}, total=4000 * 4 * 6.0).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(mean["a"] - 0.12) < 0.03 and abs(mean["b"] - 11.88) < 0.3
    big = poisson_mix.mix_sources(frame.filter("doc_id < 50"), {"a": 1}, total=50 * 4 * 700.0)
    assert abs(big.count() / 50 - 700) < 20


def test_decontamination(spark, docs, empty):
    items = [(1, TEXT), (2, "lazy dog"), (3, None), (4, ""), (None, "x"), (5, " ".join(LONG.split()[500:520])), (1, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i or -1, *brute.contamination([(0, t)], items)[0]) for i, t in ROWS)
    for block in (fm_decontam.BLOCK_ITEM_WORDS, 1):
        for shard in (fm_decontam.SHARD_WORDS, 1):
            out = fm_decontam.find_contamination(docs, bench, block_words=block, shard_words=shard)
            check_columns(out, docs, set(fm_decontam.STATE) | {"contaminated"})
            rows = out.collect()
            assert sorted((r.doc_id or -1, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest(), r.contaminated) for r in rows) == want
    cut = {r.doc_id: r.cut for r in out.filter("doc_id in (1, 7)").select("doc_id", fm_decontam.without_spans(F.col("text"), F.col("spans")).alias("cut")).collect()}
    assert cut == {1: ".", 7: ""}
    assert fm_decontam.find_contamination(empty, bench).count() == 0
    assert fm_decontam.find_contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_fm_index():
    rng = np.random.default_rng(2)
    text = np.append(np.where(rng.random(4000) < 0.02, 0, rng.integers(1, 4, 4000)), 0)
    index = fm_decontam.FmIndex(text, 4)
    phrases = [p for k in (1, 2, 5, 9) for p in {tuple(text[i:i + k]) for i in range(0, 3000, 7)} if 0 not in p and len(p) == k] + [(1, 1, 1, 1, 1, 1, 1, 1, 1)]
    rows, sizes = np.zeros((len(phrases), 9), np.int64), np.array([len(p) for p in phrases])
    for i, p in enumerate(phrases):
        rows[i, :len(p)] = p
    low, high = index.search(rows, sizes)
    for p, a, b in zip(phrases, low, high):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(text)) if tuple(text[i:i + len(p)]) == p]


def test_quality(docs, empty):
    out = quality_votes.judge_quality(docs)
    check_columns(out, docs, {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_ends", "n_digits", "n_capitals", "n_repeat_words", "base_failed", "votes", "posterior", "kept"})
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())
    assert got == sorted((i or -1, *brute.quality_counts(t)) for i, t in ROWS)
    assert quality_votes.judge_quality(empty).count() == 0


def test_votes_find_accuracies():
    rng = np.random.default_rng(9)
    truth, accuracy = rng.random(20_000) < 0.7, (0.95, 0.8, 0.65, 0.9)
    votes = [np.where(rng.random(20_000) < 0.2, 0, np.where(rng.random(20_000) < a, 1, -1) * np.where(truth, 1, -1)) for a in accuracy]
    from collections import Counter
    model = quality_votes.fit_votes(sorted(Counter(zip(*(v.tolist() for v in votes))).items()), 4, weight=1e-4)
    assert abs(model.prior - 0.7) < 0.03 and all(abs(model.accuracy(j) - a) < 0.03 for j, a in enumerate(accuracy))


@pytest.mark.parametrize("limit", [0, 100_000])
def test_lines(spark, docs, empty, limit):
    many = docs.select("doc_id", "text", "_a").unionByName(spark.createDataFrame([(100 + i, f"  SHARED line\t\nown {i}\n\nshared line") for i in range(9)] + [(200, "Shared Line")], "doc_id long, text string").withColumn("_a", F.lit("kept")))
    out = {r.doc_id: r for r in line_dedup.drop_frequent_lines(many, broadcast_lines=limit).collect()}
    assert (out[100].n_lines, out[100].n_dropped, out[100].kept_text, out[100]["_a"]) == (4, 2, "own 0\n", "kept")
    assert (out[200].n_lines, out[200].n_dropped, out[200].kept_text) == (1, 1, "") and (out[3].n_lines, out[3].n_dropped, out[3].kept_text) == (1, 0, "")
    assert out[5].kept_text == LONG and line_dedup.drop_frequent_lines(empty).count() == 0


def page(*middle, nav="Home"):
    return f"<html><head><title>t</title></head><body><div>{nav} of the <b>site</b></div><div><div>Terms apply to all</div>{''.join(f'<p>{m}' for m in middle)}</div><script>var a='<p>no</p>';</script></body></html>"


def test_wrapper(spark):
    rows = [(i, "http://h.org/%d" % i, page(f"Own words {i} &amp; more", f"second\n part   {i}"), "kept") for i in range(12)]
    rows += [(50, None, None, "kept"), (51, "", "", "kept"), (52, "http://one.org/", page("alone"), "kept"), (53, "http://one.org/", "<nav>m</nav><article><h1>T</h1>a<br>b<div class='comments'>c</div></article>x", "kept"),
             (54, "http://one.org/", "<p>open <b>and <i>crossed</b> tags</i> &eacute;<table><tr><td>1<td>2</table></nope> <!-- c -->end <", "kept")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, tree string")
    out = {r.page_id: r for r in wrapper_html.extract(pages).collect()}
    assert out[3].text == "Own words 3 & more\n\nsecond part 3" and out[3].tree == "kept"      # the wrapper found the template
    assert out[50].text == out[51].text == "" and out[50].n_chars == 0
    assert out[52].text == "Home of the site\n\nTerms apply to all\n\nalone"                  # too few pages to tell
    assert out[53].text == "T\n\na b" and out[54].text == "open and crossed tags é\n\n1\n\n2\n\nend <"
    assert wrapper_html.extract(pages.limit(0)).count() == 0


def test_alignment():
    own, pivot = "a/b\na/c/p\na/d", "a/b\na/x/p\na/c/q/p\na/d"
    assert wrapper_html.aligned(own, pivot) == {"a": "a", "a/b": "a/b", "a/c": "a/c", "a/c/p": "a/c/p", "a/d": "a/d"}
    assert wrapper_html.aligned("body/div.x/p", "body/div.y/p")["body/div.x/p"] == "body/div.y/p"


def test_language(docs, empty, spark):
    out = evidence_lang.identify(docs)
    check_columns(out, docs, {"language", "confidence", "accepted"})
    got = {r.doc_id: r.accepted for r in out.collect()}
    assert not got[3] and not got[4] and not got[6] and got[5]
    assert evidence_lang.identify(empty).count() == 0
    assert evidence_lang.identify(docs.withColumn("lang", F.lit(None).cast("string"))).filter("accepted").count() == 0


def test_language_evidence(spark, sf):
    """Pages: wrong and missing declarations are overruled by letters, short texts follow address and declaration."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", evidence_lang.markup_language(F.col("html")).alias("real"), F.regexp_replace("html", "<script.*?</script>|<[^>]*>", " ").alias("text"))
    said = F.when(F.col("page_id") % 7 == 0, "en").when(F.col("page_id") % 7 == 1, F.lit(None)).otherwise(F.col("real"))
    out = evidence_lang.identify(pages.withColumn("said", said), declared="said", address="url")
    assert out.filter("language = real and accepted").count() >= 0.97 * out.count()
    bare = pages.withColumn("said", F.col("real")).withColumn("text", F.when(F.col("page_id") % 5 == 0, "ok").otherwise(F.col("text")))
    out = evidence_lang.identify(bare, declared="said", address="url").filter("text = 'ok'")
    assert out.filter("language = real").count() >= 0.9 * out.count() > 0
