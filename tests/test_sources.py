import io
import json
import sqlite3
import zipfile

import pandas as pd
import pyarrow.feather as feather
import pytest

from millrace.functions import terms as R
from millrace.operators import triples as O
from millrace.sources import files as S, graphs as G, images as I, rdf as D, sinks as K


def test_csv_options(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("note\nmore\nid;name\n1;Zoé\n2;Bob\n".encode("cp1252"))
    got = S.read_csv(spark, str(p), sep=";", encoding="cp1252", skiprows=2).orderBy("id").collect()
    assert [(r["id"], r["name"]) for r in got] == [(1, "Zoé"), (2, "Bob")]
    q = tmp_path / "b.csv"
    q.write_text("1,x\n2,y\n")
    df = S.read_csv(spark, str(q), header=False, nrows=1)
    assert df.columns == ["_c0", "_c1"] and df.count() == 1
    b = tmp_path / "c.csv"
    b.write_bytes(b"\xef\xbb\xbfid,v\n1,2\n")
    assert S.read_csv(spark, str(b), encoding="utf-8-sig").columns == ["id", "v"]


def test_csv_skiprows_in_every_file(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f"junk {i}\n{i},a\n{i},b\n")
    assert S.read_csv(spark, str(tmp_path), skiprows=1, header=False).count() == 6


def test_sqlite(spark, tmp_path):
    p = str(tmp_path / "t.db")
    with sqlite3.connect(p) as con:
        con.execute("CREATE TABLE one (id INTEGER PRIMARY KEY, x REAL, s TEXT)")
        con.executemany("INSERT INTO one VALUES (?, ?, ?)", [(i, i / 2, None if i % 5 == 0 else f"r{i}") for i in range(1, 101)])
        con.execute("CREATE TABLE two (a TEXT)")
    df = S.read_sqlite(spark, p, partitions=4)
    assert df.count() == 100 and df.filter("s is null").count() == 20 and df.rdd.getNumPartitions() == 4
    assert S.read_sqlite(spark, p, "two").columns == ["a"]


def test_feather_zip_text(spark, tmp_path):
    feather.write_feather(pd.DataFrame({"a": [1, 2], "b": ["x", None]}), str(tmp_path / "f.feather"), compression="uncompressed")
    assert S.read_feather(spark, str(tmp_path / "f.feather")).orderBy("a").collect()[1]["b"] is None
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("d/", "")
        z.writestr("__MACOSX/x.csv", "no")
        z.writestr("d/a.csv", "id,v\n1,2\n3,4\n")
        z.writestr("d/b.json", json.dumps([{"k": 1}, {"k": 2}]))
        z.writestr("d/c.txt", "hello")
    (tmp_path / "z.zip").write_bytes(buf.getvalue())
    m = S.read_zip(spark, str(tmp_path / "z.zip"))
    assert m.count() == 3 and S.zip_csv(m, "id int, v int").count() == 2
    assert S.zip_json(m, "k int").count() == 2 and S.zip_text(m).first()["text"] == "hello"


def test_json_layout_with_schema(spark, tmp_path):
    p = tmp_path / "j.json"
    p.write_text(json.dumps({"a": {"0": 1, "1": 2}, "b": {"0": "x"}}))
    got = S.read_json(spark, str(p), orient="columns", schema="a int, b string").orderBy("a").collect()
    assert [tuple(r) for r in got] == [(1, "x"), (2, None)]


def test_post_load(spark):
    df = spark.createDataFrame([("2024-01-02", "x"), ("2024-02-03", "2024-01-01"), (None, "y")], "d string, s string")
    assert dict(S.parse_dates(df).dtypes) == {"d": "timestamp_ntz", "s": "string"}
    assert S.use_columns(df, ["nothing"]).columns == ["d", "s"]


RDF_DOC = """<?xml version="1.0"?>
<!DOCTYPE rdf:RDF [ <!ENTITY ex "http://ex.org/o#" > ]>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#"
  xmlns:owl="http://www.w3.org/2002/07/owl#" xml:base="http://ex.org/o">
<owl:Ontology rdf:about="http://ex.org/o"><owl:imports rdf:resource="http://ex.org/absent.owl"/></owl:Ontology>
<owl:Class rdf:about="#Course"><rdfs:subClassOf rdf:resource="#Thing"/>
  <rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="#has"/><owl:someValuesFrom rdf:resource="#Part"/></owl:Restriction></rdfs:subClassOf>
  <rdfs:comment xml:lang="en">a course</rdfs:comment><rdfs:comment xml:lang="fr">un cours</rdfs:comment></owl:Class>
<owl:ObjectProperty rdf:ID="has"><rdfs:domain rdf:resource="#Course"/><rdfs:domain rdf:resource="#Thing"/></owl:ObjectProperty>
</rdf:RDF>"""


def test_rdfxml(spark, tmp_path):
    p = tmp_path / "o.rdf"
    p.write_text(RDF_DOC)
    t = D.read_rdfxml(spark, str(p), base="http://ex.org/o").cache()
    has = lambda s, pr, o: t.filter((t.s == s) & (t.p == pr) & (t.o == o)).count()
    assert has("http://ex.org/o#Course", R.SUBCLASS, "http://ex.org/o#Thing") == 1
    assert has("http://ex.org/o#has", R.DOMAIN, "http://ex.org/o#Course") == has("http://ex.org/o#has", R.DOMAIN, "http://ex.org/o#Thing") == 1
    assert {r["o_lang"] for r in t.filter(t.p == R.COMMENT).collect()} == {"en", "fr"}
    blank = t.filter("o_type = 'blank'").first()["o"]
    assert has(blank, R.OWL + "onProperty", "http://ex.org/o#has") == 1 and has(blank, R.TYPE, R.OWL + "Restriction") == 1
    assert has("http://ex.org/o", R.IMPORTS, "http://ex.org/absent.owl") == 1


OWL_DOC = """<?xml version="1.0"?>
<Ontology xmlns="http://www.w3.org/2002/07/owl#" ontologyIRI="http://ex.org/w">
<Prefix name="rdfs" IRI="http://www.w3.org/2000/01/rdf-schema#"/>
<Import>http://ex.org/o</Import>
<Declaration><Class IRI="#A"/></Declaration><Declaration><DataProperty IRI="#size"/></Declaration>
<SubClassOf><Class IRI="#A"/><Class IRI="B"/></SubClassOf>
<SubClassOf><Class IRI="#A"/><ObjectSomeValuesFrom><ObjectProperty IRI="#p"/><Class IRI="#B"/></ObjectSomeValuesFrom></SubClassOf>
<DataPropertyDomain><DataProperty IRI="#size"/><Class IRI="#A"/></DataPropertyDomain>
<DataPropertyRange><DataProperty IRI="#size"/><Datatype abbreviatedIRI="xsd:int"/></DataPropertyRange>
<AnnotationAssertion><AnnotationProperty abbreviatedIRI="rdfs:label"/><IRI>#A</IRI><Literal>plain</Literal></AnnotationAssertion>
<AnnotationAssertion><AnnotationProperty abbreviatedIRI="rdfs:comment"/><IRI>#A</IRI><Literal xml:lang="fr">texte</Literal></AnnotationAssertion>
</Ontology>"""


def test_owlxml(spark, tmp_path):
    p = tmp_path / "w.owl"
    p.write_text(OWL_DOC)
    got = {(r["s"].replace("http://ex.org/w", ""), r["p"].split("#")[-1], r["o"].replace("http://ex.org/w", ""), r["o_lang"]) for r in D.read_owlxml(spark, str(p)).collect()}
    assert got == {("", "type", R.ONTOLOGY, None), ("", "imports", "http://ex.org/o", None), ("#A", "type", R.CLASS, None),
                   ("#size", "type", R.DATATYPE_PROPERTY, None), ("#A", "subClassOf", "#B", None), ("#size", "domain", "#A", None),
                   ("#size", "range", R.XSD + "int", None), ("#A", "label", "plain", None), ("#A", "comment", "texte", "fr")}


def test_sniff_and_imports(spark):
    docs = [(RDF_DOC, "x.owl"), (OWL_DOC, "y.owl"), ('{"@context": 1}', "c"), ("@prefix a: <b> .", "d"), ("<http://a> <http://b> <http://c> .", "e"), ("what", "f.ttl")]
    df = spark.createDataFrame(docs, "t string, p string").coalesce(1)
    assert [r[0] for r in df.select(D.sniff(df.t, df.p)).collect()] == ["rdfxml", "owlxml", "jsonld", "turtle", "nt", "turtle"]
    cat = spark.createDataFrame([("/d/a.owl",), ("/d/b.ttl",), ("/d/c",)], "file string")
    imp = spark.createDataFrame([("/d/a.owl", "http://x/b"), ("/d/b.ttl", "http://x/c#"), ("/d/c", "http://x/a"), ("/d/c", "http://x/lost.owl")], "file string, iri string")
    reached, missing = D.resolve_imports(cat, imp, cat.filter("file = '/d/a.owl'"))
    assert {r["file"]: r["depth"] for r in reached.collect()} == {"/d/a.owl": 0, "/d/b.ttl": 1, "/d/c": 2}
    assert [r[0] for r in missing.collect()] == ["http://x/lost.owl"]


def test_ntriples_round_trip(spark, tmp_path):
    rows = [("http://a", "http://p", 'say "hi"\n\\', "literal", "en", None), ("_:b1", "http://p", "http://c", "iri", None, None), ("http://a", "http://q", "1", "literal", None, R.XSD + "int")]
    t = spark.createDataFrame(rows, "s string, p string, o string, o_type string, o_lang string, o_datatype string")
    D.to_ntriples(t).write.text(str(tmp_path / "n"))
    assert sorted(map(tuple, D.read_ntriples(spark, str(tmp_path / "n")).collect()), key=str) == sorted(rows, key=str)


def test_graph_files(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# c\na b 3\nb c\n")
    assert {(r["src"], r["dst"]) for r in G.read_edge_list(spark, str(tmp_path / "e.txt")).collect()} == {("a", "b"), ("b", "c")}
    (tmp_path / "adj.txt").write_text("a b c\nd\n")
    assert G.read_adjacency_list(spark, str(tmp_path / "adj.txt")).count() == 2
    (tmp_path / "g.graphml").write_text('<graphml><graph><node id="n1"><data key="k">v</data></node><node id="n2"/><edge source="n1" target="n2"/></graph></graphml>')
    n, e = G.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert {r["id"]: r["attrs"] for r in n.collect()} == {"n1": {"k": "v"}, "n2": {}} and e.first()["dst"] == "n2"


def test_images(spark):
    data = bytes([0, 10, 20, 255, 255, 255])  # two pixels, blue green red
    df = spark.createDataFrame([("a", 1, 2, 3, data)], "origin string, height int, width int, nChannels int, data binary")
    assert {(r["channel"], r["level"]): r["n"] for r in I.colour_histogram(df).collect()} == {("R", 20): 1, ("G", 10): 1, ("B", 0): 1, ("R", 255): 1, ("G", 255): 1, ("B", 255): 1}
    assert I.features(df).first()["features"] == [20.0, 10.0, 0.0, 255.0, 255.0, 255.0]
    assert I.convert(df, "L", (2, 2)).first()["nChannels"] == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id long, p string")
    assert K.write_predictions(df, str(tmp_path / "out")).endswith("out.csv")
    assert K.safe_name("SVM (RBF)/x") == "SVM_RBF_x"
    for i in range(2):
        K.log_step(spark, str(tmp_path / "log"), "s", f"a{i}", {"i": i}, df, df)
    assert [r["action"] for r in K.read_log(spark, str(tmp_path / "log")).collect()] == ["a0", "a1"]


def test_rdfs_and_checks(spark):
    x = "http://e#"
    t = spark.createDataFrame([(x + f"C{i}", R.SUBCLASS, x + f"C{i + 1}", "iri") for i in range(4)] + [
        (x + "p", R.TYPE, R.OBJECT_PROPERTY, "iri"), (x + "p", R.DOMAIN, x + "C1", "iri"), (x + "a", x + "p", x + "b", "iri"),
        (x + "i", R.TYPE, x + "C0", "iri"), (x + "j", x + "p", x + "i", "iri"), (x + "j", R.TYPE, x + "C1", "iri")],
        "s string, p string, o string, o_type string").selectExpr("*", "cast(null as string) o_lang", "cast(null as string) o_datatype")
    assert O.subclass_closure(t).count() == 10 and O.subclass_closure(t, full=False).count() == 7
    again = O.rdfs_closure(O.rdfs_closure(t))
    assert again.filter("inferred").count() == 0
    assert [r["s"] for r in O.violations(t).collect()] == [x + "a"]
    one = {r["o"] for r in O.propagate_types(t).filter("inferred").filter(f"s = '{x}i'").collect()}
    assert one == {x + "C1"}
    full = {r["o"] for r in O.propagate_types(t, closure=True).filter("inferred").filter(f"s = '{x}i'").collect()}
    assert full == {x + f"C{i}" for i in range(1, 5)}


RDF_KINDS = """<?xml version="1.0"?><!DOCTYPE rdf:RDF [<!ENTITY ex "http://ex.org/k#">]>
<rdf:RDF xmlns="http://other.org/" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#"
 xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:ex="http://ex.org/k#" xml:base="http://ex.org/b">
<owl:Class rdf:about="&ex;A"/>
<ex:Person rdf:ID="p" ex:age="7"><ex:knows rdf:nodeID="n1"/><ex:knows><ex:Person rdf:nodeID="n1"/></ex:knows></ex:Person>
<rdfs:Class rdf:about="#C"><rdfs:label>c &amp; d</rdfs:label></rdfs:Class>
<owl:TransitiveProperty rdf:about="#t"/>
<owl:Class rdf:about="#U"><owl:unionOf rdf:parseType="Collection"><rdf:Description rdf:about="#C"/><owl:Class rdf:about="&ex;A"/></owl:unionOf></owl:Class>
<rdf:Bag rdf:about="#bag" xml:lang="de"><rdf:li>eins</rdf:li><rdf:li rdf:parseType="Resource"><ex:v rdf:datatype="http://www.w3.org/2001/XMLSchema#int">2</ex:v></rdf:li></rdf:Bag>
</rdf:RDF>"""


def test_rdfxml_kinds(spark, tmp_path):
    for i in range(3):   # several files: names and prefixes stay with their file
        (tmp_path / f"k{i}.rdf").write_text(RDF_KINDS.replace("ex.org/b", f"ex.org/b{i}"))
    t = D.read_rdfxml(spark, str(tmp_path)).cache()
    short = lambda x: x.replace("http://ex.org/b1#", "#").replace("http://ex.org/k#", "ex:").replace(R.RDF, "rdf:").replace(R.RDFS, "rdfs:").replace(R.OWL, "owl:")
    got = {(short(r.s), short(r.p), short(r.o), r.o_lang, r.o_datatype) for r in t.filter("s like 'http://ex.org/b1#%' or s = 'http://ex.org/k#A'").collect() if not r.o.startswith("_:")}
    assert got == {("ex:A", "rdf:type", "owl:Class", None, None), ("#p", "rdf:type", "ex:Person", None, None), ("#p", "ex:age", "7", None, None), ("#C", "rdf:type", "rdfs:Class", None, None),
                   ("#C", "rdfs:label", "c & d", None, None), ("#t", "rdf:type", "owl:TransitiveProperty", None, None), ("#U", "rdf:type", "owl:Class", None, None),
                   ("#bag", "rdf:type", "rdf:Bag", None, None), ("#bag", "rdf:_1", "eins", "de", None)}
    link = {r.p: r.o for r in t.filter("s like 'http://ex.org/b1#%' and o_type = 'blank'").collect()}
    of = lambda s: {short(r.p): r.o for r in t.filter(t.s == s).collect()}
    assert of(link["http://ex.org/k#knows"]) == {"rdf:type": "http://ex.org/k#Person"} and of(link[R.RDF + "_2"]) == {"ex:v": "2"}
    cell = of(link[R.OWL + "unionOf"])
    assert cell["rdf:first"] == "http://ex.org/b1#C" and of(cell["rdf:rest"]) == {"rdf:first": "http://ex.org/k#A", "rdf:rest": R.RDF + "nil"}


def test_readers_keep_every_row(spark, tmp_path):
    (tmp_path / "skip").mkdir(), (tmp_path / "latin").mkdir(), (tmp_path / "split").mkdir()
    for i in range(20):
        (tmp_path / "skip" / f"{i:02}.csv").write_text("note\na,b\n" + "".join(f"{i * 1000 + k},x{k}\n" for k in range(50)))
        (tmp_path / "latin" / f"{i:02}.csv").write_bytes(("a,b\r\n" + "".join(f"{i * 100 + k},é\x0c{k}\r\n" for k in range(5))).encode("cp1252"))
    df = S.read_csv(spark, str(tmp_path / "skip"), skiprows=1)
    assert df.columns == ["a", "b"] and df.count() == 1000 and df.select("a").distinct().count() == 1000
    df = S.read_csv(spark, str(tmp_path / "latin"), encoding="cp1252")
    assert df.columns == ["a", "b"] and df.count() == 100 and df.filter("b like 'é%'").count() == 100
    (tmp_path / "split" / "1.json").write_text('{"columns": ["a", "b"], "index": [0], "data": [[1, 2]]}')
    (tmp_path / "split" / "2.json").write_text('{"columns": ["b", "a"], "index": [0, 1], "data": [[3, 4], [5, 6]]}')
    assert sorted((r.a, r.b) for r in S.read_json(spark, str(tmp_path / "split"), orient="split").collect()) == [("1", "2"), ("4", "3"), ("6", "5")]
    (tmp_path / "quoted.csv").write_bytes("n;t\n1;\"two\nlines\"\n2;ü\n".encode("cp1252"))
    assert {(r.n, r.t) for r in S.read_csv(spark, str(tmp_path / "quoted.csv"), sep=";", encoding="cp1252", multiline=True).collect()} == {(1, "two\nlines"), (2, "ü")}


def test_rdfxml_is_read_in_pieces():
    """A document cut anywhere gives the same triples, and few of them are held at a time."""
    doc = RDF_KINDS.encode()
    read = lambda **kw: [list(x) for x in D._RdfXml("f.rdf", "").read(doc, **kw)]
    whole, parts = read(), read(piece=5, most=3)
    assert [t for x in parts for t in x] == [t for x in whole for t in x] and len(whole) == 1
    assert len(parts) > 3 and max(map(len, parts)) <= 3 + 1
    with pytest.raises(ValueError, match="not well formed"):
        list(D._RdfXml("f.rdf", "").read(doc[:-9]))
