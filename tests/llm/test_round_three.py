"""Hard negatives, filter audit and shards: brute force and edge cases."""

import random
import zlib
from itertools import permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import cover_tree, external_shuffle, filter_potential
from millrace.llm.queries import QUERIES

# --- hard negatives ----------------------------------------------------------------------------------------------


def mined(rows, every, positives, negatives):
    """rows: (id, label, vector) that take part."""
    whole = {i: (lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (la, va) in whole.items():
        if a % every:
            continue
        ranked = sorted((-dot(va, v), i, lab) for i, (lab, v) in whole.items() if i != a)
        for s, p, _ in [r for r in ranked if r[2] == la][:positives]:
            fits = [(i, -t) for t, i, lab in ranked if lab != la and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(a, p, k + 1, i, -s, t) for k, (i, t) in enumerate(fits)]
    return sorted(out)


SCHEMA = "vec_id long, label int, embedding array<float>, score string"


@pytest.mark.parametrize("kind", ["spread", "clustered", "ties"])
def test_negatives_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(cover_tree, "ANCHOR_ROWS", 7)
    monkeypatch.setattr(cover_tree, "BLOCK_ROWS", 50)
    draw = np.random.default_rng(5)
    n, d = 400, 6
    if kind == "ties":
        vectors = draw.integers(0, 2, (n, d)) / 2
    else:
        vectors = draw.normal(size=(n, d)) if kind == "spread" else draw.normal(size=(8, d))[draw.integers(0, 8, n)] * 3 + draw.normal(size=(n, d)) / 50
    vectors = vectors.astype(np.float32)
    labels = np.where(draw.random(n) < 1 / 3, 0, draw.integers(0, 5, n))
    rows = [(int(i), int(c), [float(x) for x in v], None) for i, c, v in zip(range(n), labels, vectors)]
    got = cover_tree.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), every=10, positives=4, negatives=6)
    want = mined([r[:3] for r in rows], 10, 4, 6)
    assert want and sorted(map(tuple, got.collect())) == want


def test_tree_bounds_and_leaves():
    draw = np.random.default_rng(6)
    v = np.round(draw.normal(size=(3000, 3)) * 200)
    v[:900] = v[0]
    t = cover_tree.build(np.arange(3000), draw.integers(0, 4, 3000), v)
    assert sorted(t.ids.tolist()) == list(range(3000)) and (t.vectors == v[t.ids]).all()
    plus = np.concatenate([t.vectors, np.sqrt(t.norm - (t.vectors ** 2).sum(1))[:, None]], axis=1)
    for k in range(len(t.radius)):
        away = np.linalg.norm(plus[t.first[k]:t.last[k]] - plus[t.centre[k]], axis=1)
        assert away.max() <= t.radius[k] + 1e-3
        assert k == 0 or t.radius[k] <= t.radius[t.parent[k]] + 1e-3
    # the longest row asks for products that only itself reaches: few leaves are open
    q = v[(v * v).sum(1).argmax()][None]
    found = cover_tree.open_leaves(t, q, lambda node: np.zeros(1, bool), np.array([float(q[0] @ q[0])]), np.array([1e300]))
    leaves = set(range(len(t.radius))) - set(t.parent.tolist())
    assert 0 < len(found[0]) < len(leaves) / 2


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0], "a"), (1, 1, [0.9, 0.1], None), (2, 2, [0.8, 0.0], "x"), (2, 2, [0.8, 0.0], "x"), (3, None, [1.0, 0.0], ""), (4, 2, None, ""),
            (5, 2, [nan, 1.0], ""), (6, 2, [inf, 1.0], ""), (8, 2, [None, 1.0], ""), (None, 2, [1.0, 1.0], ""), (9, 3, [0.5], ""), (11, 3, [], ""), (12, 4, [-1.0, 0.0], "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = cover_tree.hard_negatives(frame, every=100)
    assert sorted(map(tuple, got.collect())) == mined([(0, 1, [1.0, 0.0]), (1, 1, [np.float32(0.9), np.float32(0.1)]), (2, 2, [np.float32(0.8), 0.0]), (9, 3, [0.5, 0.0]),
                                                       (11, 3, [0.0, 0.0]), (12, 4, [-1.0, 0.0])], 100, 5, 10)
    assert cover_tree.hard_negatives(frame.limit(0)).collect() == []
    assert cover_tree.hard_negatives(frame.filter("vec_id = 1")).collect() == []


# --- filter audit ------------------------------------------------------------------------------------------------

def audited(docs, labels):
    """Applies the filters in every order, one document at a time."""
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    fails = []
    for d, text, lang in docs:
        t = text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
        own = {"A"} if len(words) < 200 else set()
        own |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        own |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t) else set()
        own |= {"D"} if any(c in t for c in "#$%&*|") else set()
        own |= {"E"} if d is not None and any(o is not None and o < d and (x or "") == t for o, x, _ in docs) else set()
        fails.append((d, lang or "", own))
    out = {}
    for part in {p for _, p, _ in fails}:
        mine = [(d, own) for d, p, own in fails if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in own for _, own in mine) - len(gone), sum(own == {f} for _, own in mine),
                                                   sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = shapley[v[-1]] if isinstance(v[-1], str) else v[-1]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_brute_force(spark):
    draw = random.Random(4)
    pool = [None, "", " \t\n", "a b c", "A B C", "x # y", "word " * 250, " ".join(f"w{i}" for i in range(230)), "UPPER " + " ".join(f"w{i}" for i in range(230)),
            "% " + "same " * 300, "a\x0bb\x0cc" * 80, "naïve ünïcode $ " * 3]
    docs = [(i, draw.choice(pool), draw.choice(["en", "de", None, ""])) for i in range(120)]
    docs += [(None, "a b c", "en"), (None, None, None), (3, docs[3][1], "fr"), docs[5], docs[5], docs[0], docs[0]]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 120, 2)] + [(None, 1, 1), (500, 1, 1), (4, 1, 0), (4, 0, 1)]
    frame = spark.createDataFrame([(*d, 7, "n") for d in docs], "doc_id long, text string, lang string, n int, mask string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = filter_potential.audit_documents(frame, marks).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows) and got == audited(docs, labels)
    assert filter_potential.audit_documents(frame.limit(0), marks).collect() == []
    assert len(filter_potential.audit_documents(frame, marks.limit(0)).collect()) == 600 * 4


def test_potential_shares_the_whole(spark):
    """The Shapley values of all filters add up to what they remove together."""
    counts = spark.createDataFrame([("x", m, (m * 7919) % 23, 0, 0) for m in range(8)], "part string, mask int, n long, good long, toxic long")
    rows = {r.filter_order[r.step - 1]: r.shapley for r in filter_potential.audit(counts, "PQR").collect()}
    assert sum(rows.values()) == 6 * sum((m * 7919) % 23 for m in range(1, 8))


# --- shards ------------------------------------------------------------------------------------------------------

def sharded(rows, shards, seed, buckets):
    """(id, text) with distinct ids -> (shard, slot), by one list per bucket. Hashes are those of 8 bytes, then of the text of the id."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    start = xxhash.xxh64_intdigest(seed.to_bytes(8, "little"), 42)
    keyed = sorted((signed(xxhash.xxh64_intdigest((f"={i}" if i is not None else "-").encode(), start)), i) for i, _ in rows)
    whole = []
    for b in range(buckets):
        own = [i for h, i in keyed if h % buckets == b]
        draws = np.random.default_rng([seed, b]).integers(0, np.arange(len(own), 0, -1)).tolist() if own else []
        for last, at in zip(range(len(own) - 1, 0, -1), draws):
            own[last], own[at] = own[at], own[last]
        whole += own
    out, n = {}, len(whole)
    for s in range(shards):
        for slot, i in enumerate(whole[n * s // shards:n * (s + 1) // shards]):
            out[i] = s, slot
    return out


def test_op13_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    size = sum(len((t or "").encode()) + 1 for _, t in rows)
    got = QUERIES["op13_external_shuffle"](spark, sf).collect()
    places = sharded(rows, 8, external_shuffle.SEED, -(-size // external_shuffle.BUCKET_BYTES))
    assert {r.doc_id: (r.shard, r.slot) for r in got} == places and len(got) == len(rows)
    text = {d: (t or "").encode() for d, t in rows}
    assert all((r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]), "rows", None) for r in got)


@pytest.mark.parametrize("shards, bucket_bytes", [(1, 1000), (3, 64), (8, 1 << 20), (50, 200)])
def test_shards_are_even_and_whole(spark, shards, bucket_bytes):
    rows = [(i, f"text {i} " * (i % 9)) for i in range(97)]
    frame = spark.createDataFrame([(i, t, "s", 1.5) for i, t in rows], "doc_id long, text string, shard string, Slot double")
    size = sum(len(t) + 1 for _, t in rows)
    found = [{r.doc_id: (r.shard, r.slot) for r in external_shuffle.shard_documents(frame.repartition(p), shards=shards, bucket_bytes=bucket_bytes).collect()} for p in (1, 5)]
    assert found[0] == found[1] == sharded(rows, shards, 1, -(-size // bucket_bytes))
    counts = np.bincount([s for s, _ in found[0].values()], minlength=shards)
    assert counts.max() - counts.min() <= 1
    assert sorted(found[0].values()) == [(s, k) for s in range(shards) for k in range(counts[s])]


def test_order_is_random():
    """Each place is as likely for each row."""
    tally = np.zeros((4, 4), int)
    for b in range(4000):
        tally[np.arange(4), external_shuffle.fisher_yates(4, 1, b)] += 1
    assert abs(tally - 1000).max() < 130
    assert external_shuffle.fisher_yates(0, 1, 0).tolist() == [] and external_shuffle.fisher_yates(1, 1, 0).tolist() == [0]


def test_shards_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(external_shuffle, "REPEATED", 5)
    rows = [(None, None)] * 40 + [(7, "same")] * 40 + [(i, "x" * 5000) for i in range(20)] + [(1, ""), (1, "other")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = external_shuffle.shard_documents(frame, shards=4, bucket_bytes=6000).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(rows, key=str)
    assert sorted((r.shard, r.slot) for r in got) == sorted((s, k) for s in range(4) for k in range((102 * (s + 1)) // 4 - 102 * s // 4))
    assert len({r.shard for r in got if r.doc_id == 7}) > 1 and len({r.shard for r in got if r.doc_id is None}) > 1
    assert external_shuffle.shard_documents(frame.limit(0)).collect() == []


def test_digests(spark, sf):
    rows = QUERIES["op13_external_shuffle"](spark, sf).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert all(r.n == r.m + 1 for r in rows) and len(rows) == 8
