"""Source queries: the files are written by Spark from the tables to shared scratch storage, then read back."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import terms as R
from millrace.plans.lineage import scratch_path
from millrace.sources import files as S, graphs as G, images as I, rdf as D, sinks as K
from workload.ontology import _SQL, _triples
from workload.registry import query, table


@query("source_csv", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def source_csv(spark, sf):
    path = scratch_path(spark, "csv")
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate").write.option("header", True).csv(path)
    return S.read_csv(spark, path, schema="o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz")


_LATIN1 = "[^\\x09\\x0a\\x0d\\x20-\\x7e\\xa0-\\xff]"


@query("source_tsv_encoded", f"SELECT doc_id, lang, md5(regexp_replace(text, '{_LATIN1}', '', 'g')) AS digest FROM documents")
def source_tsv_encoded(spark, sf):
    """Tab-separated Latin-1 without a header; capitals, quotes, tabs and line breaks stay, only what Latin-1 lacks goes."""
    path = scratch_path(spark, "tsv")
    df = table(spark, sf, "documents").select("doc_id", "lang", F.regexp_replace("text", _LATIN1, "").alias("t"))
    df.write.option("sep", "\t").option("encoding", "iso-8859-1").option("escape", '"').option("quoteAll", True).csv(path)
    back = S.read_tsv(spark, path, encoding="latin-1", header=False, schema="doc_id bigint, lang string, t string", multiline=True)
    return back.select("doc_id", "lang", F.md5(F.coalesce("t", F.lit(""))).alias("digest"))


@query("source_csv_foreign", "SELECT c_custkey, 'café ' || c_name AS name, c_acctbal FROM customer")
def source_csv_foreign(spark, sf):
    """Many small files with a header each, in an encoding that the reader lacks."""
    path = scratch_path(spark, "foreign")
    rows = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("café "), "c_name").alias("name"), "c_acctbal")
    rows.repartition(12).write.options(header=True, encoding="iso-8859-1").csv(path)   # what both encodings have in common
    return S.read_csv(spark, path, encoding="cp1252", schema="c_custkey bigint, name string, c_acctbal double")


@query("source_csv_skiprows", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def source_csv_skiprows(spark, sf):
    """Two lines to skip and a header at the head of each of many files."""
    path = scratch_path(spark, "skip")
    rows = table(spark, sf, "customer").select(F.concat_ws(";", "c_custkey", "c_name", "c_nationkey").alias("value"))
    _wrapped(rows.repartition(6), "made for a test\ntwo lines to skip\nc_custkey;c_name;c_nationkey", None).write.text(path)
    out = S.read_csv(spark, path, sep=";", skiprows=2)
    return out.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"))


@query("source_json_lines", "SELECT event_id, event_type, value FROM events")
def source_json_lines(spark, sf):
    path = scratch_path(spark, "jsonl")
    table(spark, sf, "events").select("event_id", "event_type", "value").write.json(path)
    return S.read_json(spark, path, lines=True, schema="event_id bigint, event_type string, value double")


@query("source_json_layouts", """
SELECT layout, p_brand AS name, n::BIGINT AS n FROM (SELECT p_brand, count(*) n FROM part GROUP BY 1), (SELECT unnest(['columns', 'index', 'split', 'values', 'records', 'table']) AS layout)""")
def source_json_layouts(spark, sf):
    """Brand counts as one document per layout; documents are per-brand summaries, so they stay small."""
    c = table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    rows = c.agg(F.sort_array(F.collect_list(F.struct(F.col("p_brand").alias("name"), F.col("n").cast("string").alias("n")))).alias("r"))
    idx = F.transform("r", lambda x, i: i.cast("string"))
    get = lambda k: F.transform("r", lambda x: x[k])
    docs = {
        "columns": F.to_json(F.create_map(F.lit("name"), F.map_from_arrays(idx, get("name")), F.lit("n"), F.map_from_arrays(idx, get("n")))),
        "index": F.to_json(F.map_from_arrays(idx, F.transform("r", lambda x: F.create_map(F.lit("name"), x["name"], F.lit("n"), x["n"])))),
        "split": F.to_json(F.struct(F.array(F.lit("name"), F.lit("n")).alias("columns"), idx.alias("index"), F.transform("r", lambda x: F.array(x["name"], x["n"])).alias("data"))),
        "values": F.to_json(F.transform("r", lambda x: F.array(x["name"], x["n"]))),
        "records": F.to_json("r"), "table": F.to_json(F.struct(F.col("r").alias("data")))}
    out = None
    for layout, doc in docs.items():
        path = scratch_path(spark, layout)
        rows.select(doc.alias("value")).write.text(path)
        df = S.read_json(spark, path, orient=layout)
        if layout == "values":
            df = df.withColumnsRenamed({"_c0": "name", "_c1": "n"})
        one = df.select(F.lit(layout).alias("layout"), "name", F.col("n").cast("long").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("source_parquet_orc", "SELECT count(*) AS rows, sum(p_size)::BIGINT AS size FROM part")
def source_parquet_orc(spark, sf):
    path = scratch_path(spark, "orc")
    S.read_parquet(spark, f"{sf}/part.parquet").write.orc(path)
    return S.read_orc(spark, path).agg(F.count(F.lit(1)).alias("rows"), F.sum("p_size").alias("size"))


@query("source_feather", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def source_feather(spark, sf):
    def pack(batches):
        for b in batches:
            sink = io.BytesIO()
            with pa.ipc.new_file(sink, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_pydict({"content": [sink.getvalue()]})

    packed = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").mapInArrow(pack, "content binary")
    return S.parse_feather(packed)


@query("source_text_files", "SELECT sum(length(value))::BIGINT AS characters FROM (SELECT n_name AS value FROM nation)")
def source_text_files(spark, sf):
    path = scratch_path(spark, "text")
    table(spark, sf, "nation").select(F.col("n_name").alias("value")).write.text(path)
    return S.read_text(spark, path).agg(F.sum(F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("characters"))


@query("source_zip_members", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def source_zip_members(spark, sf):
    """Every task packs its rows into archives of CSV members; the reader unpacks and parses them."""
    def pack(batches):
        for i, pdf in enumerate(batches):
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w") as z:
                z.writestr("__MACOSX/junk.csv", "x")
                for kind, part in pdf.groupby("event_type"):
                    z.writestr(f"in/{kind}.csv", part.to_csv(index=False))
            yield pd.DataFrame({"path": [f"a{i}.zip"], "content": [buf.getvalue()]})

    archives = table(spark, sf, "events").select("event_id", "event_type", "value").mapInPandas(pack, "path string, content binary")
    rows = S.zip_csv(S.unzip(archives), "event_id bigint, event_type string, value double")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("source_zip_json_text", """
SELECT 'json' AS kind, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type
UNION ALL SELECT 'text', event_type, count(*), NULL FROM events GROUP BY event_type""")
def source_zip_json_text(spark, sf):
    """Archives with a JSON member and a text member per event type; the text has a line per event."""
    def pack(batches):
        for i, pdf in enumerate(batches):
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w") as z:
                for kind, part in pdf.groupby("event_type"):
                    z.writestr(f"in/{kind}.json", part.to_json(orient="records"))
                    z.writestr(f"in/{kind}.txt", "\n".join(part["event_type"]))
            yield pd.DataFrame({"path": [f"a{i}.zip"], "content": [buf.getvalue()]})

    archives = table(spark, sf, "events").select("event_id", "event_type", "value").mapInPandas(pack, "path string, content binary")
    members = S.unzip(archives)
    json = S.zip_json(members, "event_id bigint, event_type string, value double").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.lit("json").alias("kind"), "event_type", "n", "total")
    lines = S.zip_text(members).select(F.explode(F.split("text", "\n")).alias("event_type")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return json.unionByName(lines.select(F.lit("text").alias("kind"), "event_type", "n", F.lit(None).cast("double").alias("total")))


@query("source_series_csv", "SELECT ts, value FROM events")
def source_series_csv(spark, sf):
    path = scratch_path(spark, "series")
    table(spark, sf, "events").select(F.col("ts").cast("string").alias("ts"), "value").write.option("header", True).csv(path)
    return S.read_series(spark, path).withColumn("value", F.col("value").cast("double"))


@query("load_use_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def load_use_columns(spark, sf):
    return S.use_columns(table(spark, sf, "orders"), ["o_orderkey", 3, "nothing"])


@query("load_parse_dates", "SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders")
def load_parse_dates(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("o_orderdate"), "o_orderpriority")
    return S.parse_dates(df)


@query("load_sample_exact", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws('#', o_orderkey, '42'))) i, count(*) OVER () n FROM orders) WHERE i <= round(n * 0.1)")
def load_sample_exact(spark, sf):
    return S.sample_fraction(table(spark, sf, "orders").select("o_orderkey"), 0.1, keys=["o_orderkey"])


@query("load_preview", "SELECT count(*) AS rows, 5 AS columns, sum(least(length(text), 500))::BIGINT AS shown FROM documents")
def load_preview(spark, sf):
    df = table(spark, sf, "documents")
    shown = S.text_preview(df).agg(F.sum(F.length("text"))).first()[0]
    return S.shape(df).withColumn("shown", F.lit(shown).cast("long"))


@query("load_guarded_preview", """
WITH n AS (SELECT count(*) n FROM lineitem) SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem, n WHERE n <= 1000 OR
 ('0x' || substr(md5(concat_ws('#', l_orderkey, l_partkey, l_linenumber, '42')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 500::DOUBLE / n""")
def load_guarded_preview(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return S.guarded_preview(df, ["l_orderkey", "l_partkey", "l_linenumber"], 1000, 500)


@query("load_concat_sources", """
SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS source FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, 'supplier' FROM supplier""")
def load_concat_sources(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return S.concat_sources({"customer": a, "supplier": b})


@query("source_ntriples", f"WITH {_SQL} SELECT * FROM t")
def source_ntriples(spark, sf):
    path = scratch_path(spark, "nt")
    D.to_ntriples(_triples(spark, sf)).write.text(path)
    return D.read_ntriples(spark, path)


def _wrapped(rows, head: str, tail: str | None):
    """Each task's lines between a head and a tail, so every written file is a document of its own."""
    def wrap(batches):
        yield pd.DataFrame({"value": [head]})
        yield from batches
        yield pd.DataFrame({"value": [tail] if tail else []}, dtype=str)

    return rows.mapInPandas(wrap, "value string")


@query("source_rdfxml", f"""
SELECT 'http://x.org/c' || c_custkey AS s, '{R.TYPE}' AS p, '{R.INDIVIDUAL}' AS o, 'iri' AS o_type, NULL AS o_lang, NULL AS o_datatype FROM customer
UNION ALL SELECT 'http://x.org/c' || c_custkey, 'http://x.org/nation', 'http://x.org/n' || c_nationkey, 'iri', NULL, NULL FROM customer
UNION ALL SELECT 'http://x.org/c' || c_custkey, '{R.LABEL}', c_name, 'literal', 'en', NULL FROM customer
UNION ALL SELECT 'http://x.org/c' || c_custkey, 'http://x.org/balance', c_acctbal::VARCHAR, 'literal', NULL, '{R.XSD}double' FROM customer
UNION ALL SELECT 'http://x.org/o#n' || n_nationkey, '{R.TYPE}', 'http://x.org/Nation', 'iri', NULL, NULL FROM nation
UNION ALL SELECT 'http://x.org/o#n' || n_nationkey, 'http://x.org/name', n_name, 'literal', NULL, NULL FROM nation
UNION ALL SELECT 'http://x.org/o#n' || n_nationkey, 'http://x.org/in', 'http://x.org/o#r' || n_regionkey, 'iri', NULL, NULL FROM nation
UNION ALL SELECT 'http://x.org/o#r' || r_regionkey, '{R.TYPE}', '{R.CLASS}', 'iri', NULL, NULL FROM region
UNION ALL SELECT 'http://x.org/o#r' || r_regionkey, '{R.SUBCLASS}', 'http://x.org/o#Place', 'iri', NULL, NULL FROM region""")
def source_rdfxml(spark, sf):
    """Typed nodes with absolute and relative names, property attributes, languages, datatypes, nested nodes and entities."""
    path = scratch_path(spark, "rdfxml")
    c = lambda *xs: F.concat(*[F.col(x[1:]).cast("string") if x.startswith("$") else F.lit(x) for x in xs])
    customer = c('<owl:NamedIndividual rdf:about="&x;c', "$c_custkey", '"><ex:nation rdf:resource="http://x.org/n', "$c_nationkey", '"/><rdfs:label xml:lang="en">', "$c_name",
                 '</rdfs:label><ex:balance rdf:datatype="%sdouble">' % R.XSD, "$c_acctbal", "</ex:balance></owl:NamedIndividual>")
    nation = c('<ex:Nation rdf:ID="n', "$n_nationkey", '" ex:name="', "$n_name", '"><ex:in><rdf:Description rdf:about="#r', "$n_regionkey", '"/></ex:in></ex:Nation>')
    region = c('<owl:Class rdf:about="#r', "$r_regionkey", '"><rdfs:subClassOf rdf:resource="#Place"/></owl:Class>')
    root = '<!DOCTYPE rdf:RDF [<!ENTITY x "http://x.org/">]><rdf:RDF xml:base="http://x.org/o" xmlns:rdf="%s" xmlns:rdfs="%s" xmlns:owl="%s" xmlns:ex="http://x.org/">' % (R.RDF, R.RDFS, R.OWL)
    rows = [table(spark, sf, t).select(item.alias("value")) for t, item in (("customer", customer), ("nation", nation), ("region", region))]
    _wrapped(rows[0].unionByName(rows[1]).unionByName(rows[2]), root, "</rdf:RDF>").write.text(path)
    return D.read_rdfxml(spark, path)


@query("source_owlxml", f"""
SELECT 'http://x.org/o#n' || n_nationkey AS s, '{R.TYPE}' AS p, '{R.CLASS}' AS o, NULL AS o_lang FROM nation
UNION ALL SELECT 'http://x.org/o#n' || n_nationkey, '{R.SUBCLASS}', 'http://x.org/o#r' || n_regionkey, NULL FROM nation
UNION ALL SELECT 'http://x.org/o#n' || n_nationkey, '{R.COMMENT}', 'about ' || n_name, 'en' FROM nation
UNION ALL SELECT 'http://x.org/o', '{R.TYPE}', '{R.ONTOLOGY}', NULL
UNION ALL SELECT 'http://x.org/o#c' || c_custkey, '{R.TYPE}', '{R.INDIVIDUAL}', NULL FROM customer
UNION ALL SELECT 'http://x.org/o#c' || c_custkey, 'http://x.org/o#in', 'http://x.org/o#n' || c_nationkey, NULL FROM customer""")
def source_owlxml(spark, sf):
    path = scratch_path(spark, "owlxml")
    c = lambda *xs: F.concat(*[F.col(x[1:]).cast("string") if x.startswith("$") else F.lit(x) for x in xs])
    nation = F.array(c('<Declaration><Class IRI="#n', "$n_nationkey", '"/></Declaration>'),
                     c('<SubClassOf><Class IRI="#n', "$n_nationkey", '"/><Class IRI="#r', "$n_regionkey", '"/></SubClassOf>'),
                     c('<SubClassOf><Class IRI="#n', "$n_nationkey", '"/><ObjectSomeValuesFrom><ObjectProperty IRI="#in"/></ObjectSomeValuesFrom></SubClassOf>'),
                     c('<AnnotationAssertion><AnnotationProperty abbreviatedIRI="rdfs:comment"/><IRI>#n', "$n_nationkey", '</IRI><Literal xml:lang="en">about ', "$n_name", "</Literal></AnnotationAssertion>"))
    head = '<Ontology ontologyIRI="http://x.org/o"><Prefix name="rdfs" IRI="%s"/>' % R.RDFS
    cust = F.array(c('<Declaration><NamedIndividual IRI="#c', "$c_custkey", '"/></Declaration>'),
                   c('<ObjectPropertyAssertion><ObjectProperty IRI="#in"/><NamedIndividual IRI="#c', "$c_custkey", '"/><NamedIndividual IRI="#n', "$c_nationkey", '"/></ObjectPropertyAssertion>'))
    rows = table(spark, sf, "nation").select(F.explode(nation).alias("value")).unionByName(
        table(spark, sf, "customer").select(F.explode(cust).alias("value")))
    _wrapped(rows, head, "</Ontology>").write.text(path)
    return D.read_owlxml(spark, path).select("s", "p", "o", "o_lang")


@query("source_sniff", """
SELECT page_id, CASE WHEN contains(h, '<rdf:RDF') OR contains(h, '<?xml') THEN 'rdfxml' WHEN starts_with(ltrim(h), '{') THEN 'jsonld' WHEN contains(h, '<http') AND regexp_matches(h, '(^|\\n)\\s*#') THEN 'n3' ELSE 'unknown' END AS format
FROM (SELECT page_id, substr(CASE page_id % 3 WHEN 0 THEN '<?xml version="1.0"?>' || html WHEN 1 THEN '{' || html ELSE html END, 1, 4096) AS h FROM pages)""")
def source_sniff(spark, sf):
    text = F.expr("case page_id % 3 when 0 then '<?xml version=\"1.0\"?>' || html when 1 then '{' || html else html end")
    return table(spark, sf, "pages").select("page_id", D.sniff(text).alias("format"))


@query("source_imports", """
WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 2) % 30 AS b FROM nation WHERE n_nationkey % 2 = 1),
 r AS (SELECT 1 AS k, 0 AS depth UNION SELECT b, depth + 1 FROM r JOIN e ON e.a = r.k WHERE b < 25 AND depth < 6)
SELECT '/x/n' || k || '.owl' AS file, min(depth)::INT AS depth FROM r GROUP BY 1""")
def source_imports(spark, sf):
    n = table(spark, sf, "nation")
    files = n.select(F.expr("'/x/n' || n_nationkey || '.owl' as file"))
    imports = n.filter("n_nationkey % 2 = 1").select(F.expr("'/x/n' || n_nationkey || '.owl' as file"), F.expr("'http://y.org/n' || ((n_nationkey * 2) % 30) || '#' as iri"))
    reached, _ = D.resolve_imports(files, imports, files.filter("file = '/x/n1.owl'"))
    return reached


@query("source_edge_list", "SELECT o_custkey::VARCHAR AS src, o_orderkey::VARCHAR AS dst FROM orders")
def source_edge_list(spark, sf):
    path = scratch_path(spark, "edges")
    table(spark, sf, "orders").select(F.concat_ws(" ", "o_custkey", "o_orderkey", "o_orderstatus").alias("value")).write.text(path)
    return G.read_edge_list(spark, path).select("src", "dst")


@query("source_adjacency_list", "SELECT n_regionkey::VARCHAR AS src, n_nationkey::VARCHAR AS dst FROM nation")
def source_adjacency_list(spark, sf):
    path = scratch_path(spark, "adj")
    table(spark, sf, "nation").groupBy("n_regionkey").agg(F.concat_ws(" ", F.collect_list(F.col("n_nationkey").cast("string"))).alias("d")).select(
        F.concat_ws(" ", "n_regionkey", "d").alias("value")).write.text(path)
    return G.read_adjacency_list(spark, path)


@query("source_graphml", "SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, c_mktsegment AS segment FROM customer")
def source_graphml(spark, sf):
    path = scratch_path(spark, "graphml")
    row = F.concat(F.lit('<edge source="c'), F.col("c_custkey"), F.lit('" target="n'), F.col("c_nationkey"), F.lit('"><data key="seg">'),
                   F.col("c_mktsegment"), F.lit("</data></edge>"))
    _wrapped(table(spark, sf, "customer").select(row.alias("value")), '<graphml><graph edgedefault="undirected">', "</graph></graphml>").write.text(path)
    _, edges = G.read_graphml(spark, path)
    return edges.select("src", "dst", F.col("attrs")["seg"].alias("segment"))


def _images(spark, sf):
    """An 8 × 8 image in three channels from every embedding."""
    def paint(batches):
        for pdf in batches:
            for vid, e in zip(pdf["vec_id"], pdf["embedding"]):
                px = np.clip((np.asarray(e, dtype=float) + 1) * 127, 0, 255).astype(np.uint8).reshape(8, 8, 1)
                yield pd.DataFrame({"origin": [str(vid)], "height": [8], "width": [8], "nChannels": [3],
                                    "data": [np.concatenate([px, 255 - px, px // 2], axis=2).tobytes()]})

    return table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(paint, I.CELLS)


_PX = "(SELECT unnest(list_transform(embedding, lambda e: least(greatest(trunc((e::DOUBLE + 1) * 127), 0), 255)::INT)) AS v FROM embeddings)"


@query("image_colour_histogram", f"""
SELECT 'B' AS channel, v AS level, count(*) AS n FROM {_PX} GROUP BY 2 UNION ALL SELECT 'G', 255 - v, count(*) FROM {_PX} GROUP BY 2
UNION ALL SELECT 'R', v // 2, count(*) FROM {_PX} GROUP BY 2""")
def image_colour_histogram(spark, sf):
    return I.colour_histogram(_images(spark, sf))


@query("image_facts", "SELECT vec_id::VARCHAR AS origin, 4 AS height, 6 AS width, 'L' AS mode FROM embeddings")
def image_facts(spark, sf):
    return I.image_facts(I.convert(_images(spark, sf), "L", (4, 6)))


@query("image_features", "SELECT vec_id::VARCHAR AS origin, 192 AS flat, 192 AS scaled, 150528 AS resized, 4096 AS grey FROM embeddings")
def image_features(spark, sf):
    img = _images(spark, sf)
    out = None
    for name, how in (("flat", "flatten"), ("scaled", "scale"), ("resized", "resize"), ("grey", "grey")):
        one = I.features(img, how).select("origin", F.size("features").alias(name))
        out = one if out is None else out.join(one, "origin")
    return out


@query("sink_predictions", "SELECT doc_id, (n_chars > 1500)::INT AS prediction FROM documents")
def sink_predictions(spark, sf):
    path = scratch_path(spark, "pred")
    df = table(spark, sf, "documents").select("doc_id", F.expr("cast(n_chars > 1500 as int) as prediction"))
    return S.read_csv(spark, K.write_predictions(df, path), schema="doc_id bigint, prediction int")


@query("sink_report_tables", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def sink_report_tables(spark, sf):
    from millrace.operators import profile
    folder = scratch_path(spark, "report")
    K.write_report({"top priorities": profile.top_values(table(spark, sf, "orders"), "o_orderpriority").select("value", "n"),
                    "context": K.context_table(spark, {"target": "o_orderpriority"})}, folder)
    return spark.read.parquet(f"{folder}/top_priorities")


@query("sink_step_log", """
SELECT 'clean' AS step, 'drop_rows' AS action, (SELECT count(*) FROM events) AS rows_in, (SELECT count(*) FROM events WHERE event_id % 7 > 0) AS rows_out, 2 AS cols_out""")
def sink_step_log(spark, sf):
    path = scratch_path(spark, "log")
    before = table(spark, sf, "events").select("event_id", F.expr("if(event_id % 7 = 0, null, value) as value"))
    K.log_step(spark, path, "clean", "drop_rows", {"columns": ["value"]}, before, before.dropna())
    return K.read_log(spark, path).select("step", "action", "rows_in", "rows_out", "cols_out")
