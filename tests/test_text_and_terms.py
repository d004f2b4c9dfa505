"""Text vectors without shuffles, closures, equivalents and N-Triples."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import terms as R
from millrace.operators import text_features as TF, triples as O
from millrace.sources import rdf as D

ROWS = [(1, "the cat and the dog"), (2, ""), (3, None), (4, "Dog dog DOG bird a"), (5, "zebra"), (6, "the cat sat " * 500)]


@pytest.mark.parametrize("ngrams", [1, 2])
def test_counts_and_weights(spark, ngrams):
    df = spark.createDataFrame(ROWS, "id int, t string")
    words = {i: [w for w in (t or "").lower().split() if len(w) > 1] for i, t in ROWS}
    terms = {i: w + ([f"{a} {b}" for a, b in zip(w, w[1:])] if ngrams == 2 else []) for i, w in words.items()}
    whole = Counter(x for w in terms.values() for x in w)
    vocabulary = sorted(whole, key=lambda x: (-whole[x], x))[:4]
    want = {(i, x): n for i, w in terms.items() for x, n in Counter(w).items() if x in vocabulary}
    assert {(r.id, r.term): r.tf for r in TF.term_counts(df, "id", "t", vocabulary, ngrams).collect()} == want
    got = {(r.id, r.term): r.weight for r in TF.tfidf(df, "id", "t", 4, ngrams).collect()}
    idf = {x: math.log(7 / (1 + sum(x in w for w in terms.values()))) + 1 for x in vocabulary}
    for (i, x), n in want.items():
        norm = math.sqrt(sum((k * idf[y]) ** 2 for (j, y), k in want.items() if j == i))
        assert got[i, x] == pytest.approx(n * idf[x] / norm)
    assert got.keys() == want.keys()


@pytest.mark.parametrize("size", [1, 3, 7, 40, 500])
def test_vocabulary_of_pairs_without_the_table_of_all_pairs(spark, monkeypatch, size):
    """Words and pairs by frequency, then by term, with many ties; few pairs are counted."""
    rng = random.Random(size)
    texts = [" ".join(rng.choices(["aa", "bb", "cc", "dd", "ee"] + [f"w{j}" for j in range(60)], [9, 8, 7, 6, 5] + [1] * 60, k=rng.randrange(30))) for _ in range(60)]
    words = [t.split() for t in [*texts, "zz aa", "zz aa"]] + [[]]
    terms = [w + [f"{a} {b}" for a, b in zip(w, w[1:])] for w in words]
    whole = Counter(x for t in terms for x in t)
    want = sorted(whole, key=lambda x: (-whole[x], x))[:size]
    seen, frequent = [], TF._frequent
    monkeypatch.setattr(TF, "_frequent", lambda t, n: seen.append(t.select(F.explode("terms").alias("t")).distinct().count()) or frequent(t, n))
    for seconds in (10, 1):
        monkeypatch.setattr(TF, "SECONDS", seconds)
        got = TF.fit_vocabulary(spark.createDataFrame([*[(i, " ".join(w)) for i, w in enumerate(words)], (99, None)], "id int, t string"), "id", "t", size, 2)
        assert got == {x: sum(x in t for t in terms) for x in want}
    assert size > 3 or max(seen) < len(whole) / 3


def test_one_stage_after_the_vocabulary(spark):
    df = spark.createDataFrame(ROWS, "id int, t string")
    for out in (TF.apply_tfidf(df, "id", "t", {"cat": 1.5, "dog": 2.0}), TF.term_counts(df, "id", "t", ["cat"]), TF.hashing_vector(df, "id", "t")):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert TF.apply_tfidf(df, "id", "t", {}).collect() == []
    assert TF.tfidf(df.limit(0), "id", "t").collect() == []


IRI = "s string, p string, o string, o_type string, o_lang string, o_datatype string"


def graph(spark, edges, predicate):
    return spark.createDataFrame([(a, predicate, b, "iri", None, None) for a, b in edges], IRI)


def test_closure_of_chain_cycle_and_diamond(spark):
    edges = [(f"c{i}", f"c{i + 1}") for i in range(37)] + [("x", "y"), ("y", "z"), ("z", "x"), ("z", "c30"), ("l", "c5"), ("r", "c5"), ("top", "l"), ("top", "r"), ("me", "me")]
    reach = {a: {b for s, b in edges if s == a} for a, _ in edges}
    grown = True
    while grown:
        grown = False
        for a, out in reach.items():
            more = set().union(*(reach.get(b, set()) for b in out)) - out
            out |= more
            grown |= bool(more)
    got = O.subclass_closure(graph(spark, edges * 2, R.SUBCLASS)).collect()
    assert len(got) == len(set(got)) and {(r.src, r.dst) for r in got} == {(a, b) for a, out in reach.items() for b in out}
    assert O.subclass_closure(graph(spark, edges, R.TYPE)).count() == 0


def test_equivalents_of_a_large_class(spark):
    n = 2000
    t = graph(spark, [(f"k{i}", f"k{(i * 7 + 1) % n}") for i in range(n)] + [(f"k{i}", f"k{i + 1}") for i in range(n - 1)] + [("a", "b"), ("b", "b")], R.EQUIVALENT_CLASS)
    asserted = t.select("s", "o").distinct().filter("s <> o").count()
    out = O.materialise_equivalents(t)
    assert out.filter("inferred").count() == n * (n - 1) + 2 - asserted
    assert out.filter("inferred and s = o").count() == 0


LINES = [
    (r'<http://a> <http://p> "x\\n" .', ("http://a", "http://p", "x\\n", "literal", None, None)),
    (r'<http://a> <http://p> "café \U0001F600 \t\"q\"\\" . # a comment with "quotes" .', ("http://a", "http://p", 'caf\xe9 \U0001f600 \t"q"\\', "literal", None, None)),
    (r'<http://a><http://p>"tight"@en-GB.', ("http://a", "http://p", "tight", "literal", "en-GB", None)),
    (r'_:b.1 <http://p> _:c. # end', ("_:b.1", "http://p", "_:c", "blank", None, None)),
    (r'<http://a/é> <http://p> "1"^^<http://tA> .', ("http://a/\xe9", "http://p", "1", "literal", None, "http://tA")),
    (r'<http://a> <http://p> "\\u0041 \\\\n \b\f\r\n\'" .', ("http://a", "http://p", "\\u0041 \\\\n \b\f\r\n'", "literal", None, None)),
    (r'<http://a#x> <http://p> "has # and . and <b>" .', ("http://a#x", "http://p", "has # and . and <b>", "literal", None, None)),
    (r'<http://a> <http://p> "" .', ("http://a", "http://p", "", "literal", None, None)),
    ("# only a comment", None), ("", None), ("<http://a> <http://p> <http://b>", None), ('<http://a> "p" <http://b> .', None), ('"s" <http://p> <http://b> .', None),
]


def test_ntriples_lines(spark, tmp_path):
    (tmp_path / "a.nt").write_text("\n".join(x for x, _ in LINES), encoding="utf-8")
    got = sorted(map(tuple, D.read_ntriples(spark, f"{tmp_path}/a.nt").collect()), key=str)
    assert got == sorted([w for _, w in LINES if w], key=str)
    # written and read again, nothing changes
    D.to_ntriples(spark.createDataFrame(got, IRI)).write.text(f"{tmp_path}/again")
    assert sorted(map(tuple, D.read_ntriples(spark, f"{tmp_path}/again").collect()), key=str) == got


def test_blank_labels_of_documents(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.nt").write_text("_:x <http://p> _:y .\n_:x <http://q> _:x .\n")
    t = D.read_ntriples(spark, f"{tmp_path}/*.nt", documents=True).collect()
    assert len({r.s for r in t}) == 2 and len({r.o for r in t}) == 4
    assert len({r.s for r in D.read_ntriples(spark, f"{tmp_path}/*.nt").collect()}) == 1


def test_sniff_rules_of_n3(spark):
    texts = ["@forAll :x .\n{ :x a :B } => { :x a :C } .", "<http://r> <http://is> 1 .\n{ ?x a ?y } <= { ?y a ?x } .", "<http://a> <http://b> <http://c> .\n# a note on <http://x>"]
    df = spark.createDataFrame([(x,) for x in texts], "t string").coalesce(1)
    assert [r[0] for r in df.select(D.sniff(df.t)).collect()] == ["n3", "n3", "nt"]


def test_known_triples_are_not_broadcast(spark, tmp_path):
    """Inferred triples meet the known ones by a shuffle, however small the files say that these are."""
    rows = [(f"x{i}", R.TYPE, "B", "iri", None, None) for i in range(20)] + [("B", R.SUBCLASS, "A", "iri", None, None), ("x3", R.TYPE, "A", "iri", None, None)]
    spark.createDataFrame(rows, "s string, p string, o string, o_type string, o_lang string, o_datatype string").write.parquet(f"{tmp_path}/t")
    out = O.propagate_types(spark.read.parquet(f"{tmp_path}/t"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not any("BroadcastHashJoin" in x and "LeftAnti" in x for x in plan.split("\n"))
    assert sorted(r["s"] for r in out.filter("inferred").collect()) == sorted(f"x{i}" for i in range(20) if i != 3)


def test_nearly_unique_triples_are_not_combined_in_the_scan(spark):
    """Repeated triples count once among the kinds and each time in the total; the scan keeps no table of all triples."""
    rows = [(f"http://x/a#i{i % 30}", R.TYPE, R.INDIVIDUAL, "iri", None, None) for i in range(40)] + [
        ("http://x/b#C", R.TYPE, R.CLASS, "iri", None, None), ("http://x/b#C", R.TYPE, "http://x/b#D", "iri", None, None), (None, None, "v", "literal", "en", None)]
    t = spark.createDataFrame(rows, "s string, p string, o string, o_type string, o_lang string, o_datatype string")
    assert tuple(O.counts(t).first()) == (43, 1, 0, 0, 0, 30, 4)   # two namespaces, that of rdf and none
    assert tuple(O.counts(t.limit(0)).first()) == (None,) * 6 + (0,)
    assert tuple(O.counts(t.filter("s is null")).first()) == (1, 0, 0, 0, 0, 0, 1)
    assert O.union_graphs(t, t).count() == 33
    plan = O.union_graphs(t, t)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange"):]
    assert "Exchange hashpartitioning" in plan and "Aggregate" not in below
