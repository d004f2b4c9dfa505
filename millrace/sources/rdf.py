"""Triples from N-Triples, RDF/XML and OWL/XML, format sniffing and import resolution.

N-Triples is the path for large data: a line is a triple and files are split. RDF/XML nests without bound, so a task
streams one file at a time through the standard library's parser. OWL/XML goes through the splittable XML reader,
one row per element.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from urllib.parse import urljoin
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions import terms as R

TRIPLE = "struct<s:string,p:string,o:string,o_type:string,o_lang:string,o_datatype:string>"
TRIPLE_DDL = "s string, p string, o string, o_type string, o_lang string, o_datatype string"


def _triple(s: Column, p, o: Column, kind: str, lang: Column | None = None, dt: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(s.alias("s"), (p if isinstance(p, Column) else F.lit(p)).alias("p"), o.alias("o"), F.lit(kind).alias("o_type"),
                    (none if lang is None else lang.cast("string")).alias("o_lang"),
                    (none if dt is None else dt.cast("string")).alias("o_datatype"))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


#: the terms of a line; white space between them may be missing, a blank label doesn't end with a dot
_IRI, _BLANK = r"<[^\x00-\x20<>\"{}|^`]*>", r"_:[^\s<>\"#]*[^\s<>\"#.]"
_STRING = r"\"(?:[^\"\\\n\r]|\\.)*\""
_LINE = rf"^\s*({_IRI}|{_BLANK})\s*({_IRI})\s*(?:({_IRI}|{_BLANK})|({_STRING})(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^({_IRI}))?)\s*\.\s*(?:#.*)?$"
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescaped(c: Column) -> Column:
    """A string's escapes undone from left to right, each once; a backslash before any other character stays."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+|\\$"), F.lit(0))
    point = lambda x: F.decode(F.unhex(F.lpad(F.substr(x, F.lit(3)), 8, "0")), "UTF-32")

    def plain(x: Column) -> Column:
        return F.when(~x.startswith("\\"), x).when(F.length(x) > 2, point(x)).otherwise(F.coalesce(_lookup(_ESCAPES, F.substr(x, F.lit(2), F.lit(1))), x))

    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(parts, plain), "")).otherwise(c)


def read_ntriples(spark: SparkSession, path: str, documents: bool = False) -> DataFrame:
    """One line, one triple; comments, also behind a triple, and malformed lines are left out. Fully splittable.

    The files below ``path`` are parts of one document, as Spark writes them, or with ``documents`` each one is its own: blank
    labels of different files are then different nodes.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    part = lambda i: F.regexp_extract("value", _LINE, i)
    t = lines.filter(F.col("value").rlike(_LINE)).select("file", *[part(i).alias(c) for i, c in enumerate(("s", "p", "node", "string", "lang", "datatype"), 1)])
    scope = F.concat(F.lit("_:"), F.substring(F.md5("file"), 1, 16), F.lit("n")) if documents else F.lit("_:")

    def bare(c: str) -> Column:
        x = F.col(c)
        return F.when(x.startswith("_:"), F.concat(scope, F.substr(x, F.lit(3)))).otherwise(unescaped(F.substr(x, F.lit(2), F.length(x) - 2)))

    lit = F.col("string") != ""
    return t.select(bare("s").alias("s"), bare("p").alias("p"), F.when(lit, unescaped(F.substr(F.col("string"), F.lit(2), F.length("string") - 2))).otherwise(bare("node")).alias("o"),
                    F.when(lit, "literal").when(F.col("node").startswith("_:"), "blank").otherwise("iri").alias("o_type"),
                    F.nullif(F.col("lang"), F.lit("")).alias("o_lang"), F.when(F.col("datatype") != "", bare("datatype")).alias("o_datatype"))


def to_ntriples(t: DataFrame) -> DataFrame:
    """(value): the triples as N-Triples lines."""
    wrap = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    esc = F.col("o")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).when(
        F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), F.col("o_datatype"), F.lit(">"))).otherwise("")
    obj = F.when(F.col("o_type") == "literal", F.concat(F.lit('"'), esc, F.lit('"'), tail)).otherwise(wrap(F.col("o")))
    return t.select(F.concat_ws(" ", wrap(F.col("s")), wrap(F.col("p")), obj, F.lit(".")).alias("value"))


#: What stands before the root element of an XML document: declaration, comments, a document type with its definitions.
_PROLOG = r"(?s)^\ufeff?(?:\s|<\?.*?\?>|<!--.*?-->|<!DOCTYPE\s+[^\[>]*(?:\[.*?\]\s*)?>)*"
_ROOT = _PROLOG + r"<(?:[\w.-]+:)?([\w.-]+)"
_DOCTYPE = r"(?s)^\ufeff?(?:\s|<\?.*?\?>|<!--.*?-->)*<!DOCTYPE\s+(?:[\w.-]+:)?([\w.-]+)"
#: fixed values: root elements and line marks by which the formats are told, in order, and the telling file endings
_ROOTS = {"Ontology": "owlxml", "RDF": "rdfxml"}
_MARKS = [("rdfxml", r"^\s*<\?xml\s"), ("jsonld", r"^\s*[\{\[]"), ("turtle", r"(?im)^\s*@?(prefix|base)\s+\S*\s*<"),
          ("n3", r"(?m)^\s*@for(All|Some)\s|\}\s*<?=>?\s*\{"), ("nt", r"(?m)^(<[^>]+>|_:\S+)\s+<[^>]+>\s+\S")]
_ENDINGS = {"ttl": "turtle", "nt": "nt", "n3": "n3", "jsonld": "jsonld"}


def sniff(text: Column, path: Column | None = None) -> Column:
    """Format of a document by its first 4096 characters: the root element of XML (or the one its document type names), else the
    first line mark that is found. A telling file ending wins over the content."""
    head = F.substring(text, 1, 4096)
    root = F.coalesce(_lookup(_ROOTS, F.regexp_extract(head, _ROOT, 1)), _lookup(_ROOTS, F.regexp_extract(head, _DOCTYPE, 1)))
    marks = [F.when(head.rlike(pattern), F.lit(name)) for name, pattern in _MARKS]
    ending = [_lookup(_ENDINGS, F.lower(F.regexp_extract(path, r"\.(\w+)$", 1)))] if path is not None else []
    return F.coalesce(*ending, root, *marks, F.lit("unknown"))


# RDF/XML ----------------------------------------------------------------------------------------------

_XML = "http://www.w3.org/XML/1998/namespace"


class _RdfXml:
    """One pass over one document after the W3C grammar: node elements and property elements take turns.

    A frame of the stack is ["node", subject, number of rdf:li] or ["prop", subject, predicate, datatype, text, filled, list, mode];
    language and base are inherited on a stack of their own.
    """

    def __init__(self, path: str, base: str):
        self.blank = "_:" + hashlib.md5(path.encode()).hexdigest()[:16] + "x"
        self.base, self.path, self.count, self.stack, self.scope, self.out = base, path, 0, [], [(None, None)], []

    def fresh(self, name: str | None = None) -> str:
        self.count += name is None
        return f"{self.blank}{self.count}" if name is None else f"{self.blank}n{name}"

    def iri(self, ref: str) -> str:
        base = self.scope[-1][1] or self.base
        return base.split("#")[0] + ref if not ref or ref[0] == "#" else urljoin(base, ref)

    def emit(self, s: str, p: str, o: str, kind: str | None = None, lang: str | None = None, datatype: str | None = None) -> None:
        self.out.append((s, p, o, kind or ("blank" if o.startswith("_:") else "iri"), lang, datatype))

    def declared(self, prefix: str | None, uri: str | None) -> None:
        if prefix is None and not self.base and uri:
            self.base = uri.rstrip("#")      # without xml:base the default namespace names the document

    def start(self, tag: str, found: list[str]) -> None:
        pairs = dict(zip(found[::2], found[1::2]))
        name = lambda x: "".join(x.split(" "))
        own = {name(k): v for k, v in pairs.items() if not k.startswith(_XML)}
        lang, base = self.scope[-1]
        self.scope.append((pairs.get(f"{_XML} lang", lang) or None, pairs.get(f"{_XML} base", base)))
        tag, rdf, top = name(tag), R.RDF, self.stack[-1] if self.stack else None
        if top is None and tag == rdf + "RDF":
            self.stack.append(["root"])
        elif top is not None and top[0] == "prop" and top[7] == "Literal":
            top[4].append("")
            self.stack.append(["skip"])
        elif top is not None and top[0] == "skip":
            self.stack.append(["skip"])
        elif top is None or top[0] in ("root", "prop"):
            self.node(tag, own, top)
        else:
            self.prop(tag, own, top)

    def subject(self, own: dict[str, str]) -> str:
        for key, make in (("about", self.iri), ("ID", lambda x: self.iri("#" + x)), ("nodeID", self.fresh)):
            if R.RDF + key in own:
                return make(own.pop(R.RDF + key))
        return self.fresh()

    def attributes(self, s: str, own: dict[str, str]) -> None:
        for k, v in own.items():
            if k == R.TYPE:
                self.emit(s, k, self.iri(v))
            elif k.startswith(R.RDF) and k[len(R.RDF):] in ("about", "ID", "nodeID", "resource", "parseType", "datatype", "bagID"):
                continue
            elif ":" in k:
                self.emit(s, k, v, "literal", self.scope[-1][0])

    def node(self, tag: str, own: dict[str, str], parent: list | None) -> None:
        s = self.subject(own)
        if parent is not None and parent[0] == "prop":
            parent[5] = True
            if parent[7] == "Collection":
                parent[6].append(s)
            else:
                self.emit(parent[1], parent[2], s)
        if tag != R.RDF + "Description":
            self.emit(s, R.TYPE, tag)
        self.attributes(s, own)
        self.stack.append(["node", s, 0])

    def prop(self, tag: str, own: dict[str, str], node: list) -> None:
        if tag == R.RDF + "li":
            node[2] += 1
            tag = f"{R.RDF}_{node[2]}"
        s, mode = node[1], own.get(R.RDF + "parseType")
        frame = ["prop", s, tag, own.get(R.RDF + "datatype"), [], False, [], mode]
        if mode == "Resource":
            o = self.fresh()
            self.emit(s, tag, o)
            frame = ["node", o, 0]
        elif mode is None and R.RDF + "datatype" not in own:
            rest = {k: v for k, v in own.items() if k != R.RDF + "ID"}
            if rest:
                o = self.iri(rest.pop(R.RDF + "resource")) if R.RDF + "resource" in rest else self.subject({k: v for k, v in rest.items() if k == R.RDF + "nodeID"})
                self.emit(s, tag, o)
                self.attributes(o, rest)
                frame[5] = True
        self.stack.append(frame)

    def text(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "prop":
            self.stack[-1][4].append(data)

    def end(self, tag: str) -> None:
        frame = self.stack.pop()
        if frame[0] == "prop":
            _, s, p, datatype, text, filled, items, mode = frame
            if mode == "Collection":
                cells = [self.fresh() for _ in items]
                self.emit(s, p, cells[0] if cells else R.RDF + "nil")
                for i, item in enumerate(items):
                    self.emit(cells[i], R.RDF + "first", item)
                    self.emit(cells[i], R.RDF + "rest", cells[i + 1] if i + 1 < len(cells) else R.RDF + "nil")
            elif not filled:
                typed = R.RDF + "XMLLiteral" if mode == "Literal" else datatype and self.iri(datatype)
                self.emit(s, p, "".join(text), "literal", None if typed else self.scope[-1][0], typed)
        self.scope.pop()

    def read(self, content, piece: int = 1 << 20, most: int = 10_000) -> Iterator[list[tuple]]:
        """The triples in lists of about ``most``; the document is parsed piece by piece, so that few are held."""
        parser = expat.ParserCreate(namespace_separator=" ")
        parser.ordered_attributes, parser.buffer_text = True, True
        parser.StartNamespaceDeclHandler, parser.StartElementHandler = self.declared, self.start
        parser.EndElementHandler, parser.CharacterDataHandler = self.end, self.text
        view = memoryview(content)
        try:
            for at in range(0, len(view), piece):
                parser.Parse(bytes(view[at:at + piece]), False)
                while len(self.out) >= most:
                    yield self.out[:most]
                    del self.out[:most]
            parser.Parse(b"", True)
        except expat.ExpatError as e:
            raise ValueError(f"{self.path} is not well formed: {e}") from e
        yield self.out


def read_rdfxml(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """Distinct triples of RDF/XML files: typed nodes, rdf:about, ID, nodeID and xml:base, property attributes, containers, the three
    parse types, languages and datatypes. Nested XML literals keep their text alone; reified statements are not made.

    Without ``base`` and xml:base relative names are read against the document's default namespace, else its path.
    """
    columns = [f.split()[0] for f in TRIPLE_DDL.split(", ")]

    def parse(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for found in _RdfXml(file, base).read(content.as_buffer()):   # the column's memory, not a copy
                    yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in found], pa.string()) for i in range(6)], names=columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, TRIPLE_DDL).distinct()


# OWL/XML ----------------------------------------------------------------------------------------------

_ENTITY = "struct<_IRI:string,_abbreviatedIRI:string>"
# fixed values: declared kinds and the classes they stand for
_DECLARED = {"Class": R.CLASS, "ObjectProperty": R.OBJECT_PROPERTY, "DataProperty": R.DATATYPE_PROPERTY,
             "AnnotationProperty": R.ANNOTATION_PROPERTY, "NamedIndividual": R.INDIVIDUAL, "Datatype": R.RDFS + "Datatype"}


def read_owlxml(spark: SparkSession, path: str) -> DataFrame:
    """Distinct triples of declarations, named subclasses, domains, ranges, annotations and assertions."""
    prefixes = spark.read.format("xml").option("rowTag", "Prefix").schema("_name string, _IRI string").load(path)
    table = {**{"rdf:": R.RDF, "rdfs:": R.RDFS, "owl:": R.OWL, "xsd:": R.XSD},
             **{(r["_name"] or "") + ":": r["_IRI"] for r in prefixes.distinct().collect()}}
    heads = (spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_extract("value", r'ontologyIRI="([^"]*)"', 1).alias("base"))
             .filter("base <> ''").groupBy("file").agg(F.min("base").alias("base")))
    lut = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])

    def rows(tag: str, schema: str) -> DataFrame:
        r = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).withColumn("file", F.col("_metadata.file_path"))
        return r.join(F.broadcast(heads), "file", "left").fillna("", ["base"])  # one row per file

    def full(iri: Column) -> Column:
        return (F.when(iri.startswith("#"), F.concat(F.col("base"), iri))
                .when(iri.rlike(r"^[A-Za-z][\w+.-]*:"), iri).otherwise(F.concat(F.col("base"), F.lit("#"), iri)))

    def ref(e: Column) -> Column:
        short = e["_abbreviatedIRI"]
        head = F.concat(F.substring_index(short, ":", 1), F.lit(":"))
        return F.coalesce(full(e["_IRI"]), F.concat(F.try_element_at(lut, head), F.substring_index(short, ":", -1)))

    def flat(df: DataFrame, *triples: Column) -> DataFrame:
        return df.select(F.explode(F.array(*triples)).alias("t")).select("t.*").filter("s is not null and p is not null and o is not null")

    out = [heads.select(F.col("base").alias("s"), F.lit(R.TYPE).alias("p"), F.lit(R.ONTOLOGY).alias("o"), F.lit("iri").alias("o_type"),
                        F.lit(None).cast("string").alias("o_lang"), F.lit(None).cast("string").alias("o_datatype"))]
    declared = rows("Declaration", ", ".join(f"{k} {_ENTITY}" for k in _DECLARED))
    out.append(flat(declared, *[_triple(ref(F.col(k)), R.TYPE, F.lit(v), "iri") for k, v in _DECLARED.items()]))
    sub = rows("SubClassOf", f"Class array<{_ENTITY}>").filter("size(Class) = 2")
    out.append(flat(sub, _triple(ref(F.col("Class")[0]), R.SUBCLASS, ref(F.col("Class")[1]), "iri")))
    for tag, prop, filler, pred in (("ObjectPropertyDomain", "ObjectProperty", "Class", R.DOMAIN), ("DataPropertyDomain", "DataProperty", "Class", R.DOMAIN),
                                    ("ObjectPropertyRange", "ObjectProperty", "Class", R.RANGE), ("DataPropertyRange", "DataProperty", "Datatype", R.RANGE)):
        d = rows(tag, f"{prop} {_ENTITY}, {filler} {_ENTITY}")
        out.append(flat(d, _triple(ref(F.col(prop)), pred, ref(F.col(filler)), "iri")))
    ann = rows("AnnotationAssertion", f"AnnotationProperty {_ENTITY}, IRI array<string>, AbbreviatedIRI string, "
                                      "Literal struct<_VALUE:string,`_xml:lang`:string,_datatypeIRI:string>")
    subject = F.coalesce(full(F.get("IRI", F.lit(0))), F.concat(
        F.try_element_at(lut, F.concat(F.substring_index("AbbreviatedIRI", ":", 1), F.lit(":"))), F.substring_index("AbbreviatedIRI", ":", -1)))
    prop = ref(F.col("AnnotationProperty"))
    out.append(flat(ann, _triple(subject, prop, F.col("Literal._VALUE"), "literal", F.col("Literal")["_xml:lang"], F.col("Literal._datatypeIRI")),
                    _triple(subject, prop, full(F.get("IRI", F.lit(1))), "iri")))
    link = rows("ObjectPropertyAssertion", f"ObjectProperty {_ENTITY}, NamedIndividual array<{_ENTITY}>").filter("size(NamedIndividual) = 2")
    out.append(flat(link, _triple(ref(F.col("NamedIndividual")[0]), ref(F.col("ObjectProperty")), ref(F.col("NamedIndividual")[1]), "iri")))
    imports = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_extract("value", r"<Import>\s*([^<\s]+)\s*</Import>", 1).alias("iri")) \
        .filter("iri <> ''").join(F.broadcast(heads), "file")
    out.append(flat(imports, _triple(F.col("base"), R.IMPORTS, F.col("iri"), "iri")))
    return reduce(lambda a, b: a.unionByName(b), out).distinct()


# imports ----------------------------------------------------------------------------------------------

SUFFIXES = ["", ".owl", ".rdf", ".ttl", ".n3"]


def resolve_imports(catalogue: DataFrame, imports: DataFrame, roots: DataFrame, depth: int = 6) -> tuple[DataFrame, DataFrame]:
    """(reached, unresolved) from ``catalogue(file)``, ``imports(file, iri)`` and ``roots(file)``.

    An import names a file when its last path segment equals the file's name, with or without one of the
    known endings. Followed breadth first to ``depth``; a cycle ends by itself.
    """
    from millrace.plans.lineage import cut
    name = F.substring_index("file", "/", -1)
    stem = F.regexp_replace(name, r"\.(owl|rdf|ttl|n3)$", "")
    named = catalogue.select("file", F.explode(F.array_distinct(F.array(name, stem))).alias("name")).distinct()
    asked = imports.select(F.col("file").alias("src"), "iri", F.regexp_extract(F.regexp_replace("iri", "[#/]+$", ""), r"([^/#]+)$", 1).alias("name"))
    found = asked.join(named.groupBy("name").agg(F.min("file").alias("file")), "name", "left")
    edges = cut(found.select("src", "iri", F.col("file").alias("dst")))
    reached = cut(roots.select("file", F.lit(0).alias("depth")).distinct())
    frontier = reached
    for level in range(1, depth + 1):
        step = (edges.filter("dst is not null").join(frontier.select(F.col("file").alias("src")), "src", "left_semi")
                .select(F.col("dst").alias("file")).distinct().join(reached, "file", "left_anti").withColumn("depth", F.lit(level)))
        frontier = cut(step)
        if frontier.isEmpty():
            break
        reached = cut(reached.unionByName(frontier))
    missing = edges.filter("dst is null").join(reached.select(F.col("file").alias("src")), "src", "left_semi").select("iri").distinct()
    return reached, missing
