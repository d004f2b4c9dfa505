from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from millrace.functions import terms as R
from millrace.operators import graph as G, text_features as TF, triples as O
from workload.registry import query, table

X = "http://example.org/geo#"
_I, _L = "'iri'", "'literal'"
_N = "NULL"

# (table, filter, s, p, o, o_type, o_lang, o_datatype); the same expressions run in both engines
_RULES = [
    ("region", "true", f"'{X}region_' || r_regionkey", R.TYPE, f"'{R.CLASS}'", _I, _N, _N),
    ("region", "true", f"'{X}region_' || r_regionkey", R.SUBCLASS, f"'{X}Place'", _I, _N, _N),
    ("region", "true", f"'{X}region_' || r_regionkey", R.LABEL, "r_name", _L, "'en'", _N),
    ("region", "r_regionkey = 0", f"'{X}Place'", R.TYPE, f"'{R.CLASS}'", _I, _N, _N),
    ("nation", "true", f"'{X}nation_' || n_nationkey", R.TYPE, f"'{R.CLASS}'", _I, _N, _N),
    ("nation", "true", f"'{X}nation_' || n_nationkey", R.SUBCLASS, f"'{X}region_' || n_regionkey", _I, _N, _N),
    ("nation", "true", f"'{X}nation_' || n_nationkey", R.LABEL, "n_name", _L, "'en'", _N),
    ("nation", "n_nationkey % 3 = 0", f"'{X}nation_' || n_nationkey", R.LABEL, "'A ' || n_name", _L, "'fr'", _N),
    ("nation", "n_nationkey % 2 = 0", f"'{X}nation_' || n_nationkey", R.COMMENT, "'about ' || n_name", _L, "'en'", _N),
    ("nation", "n_nationkey % 5 = 0", f"'{X}nation_' || n_nationkey", R.EQUIVALENT_CLASS, f"'{X}nation_' || (n_nationkey + 1)", _I, _N, _N),
    ("nation", "n_nationkey % 10 = 0", f"'{X}nation_' || (n_nationkey + 1)", R.EQUIVALENT_CLASS, f"'{X}nation_' || (n_nationkey + 2)", _I, _N, _N),
    ("nation", "n_nationkey < 12", f"'{X}livesIn'", R.DOMAIN, f"'{X}nation_' || n_nationkey", _I, _N, _N),
    ("region", "r_regionkey = 0", f"'{X}livesIn'", R.TYPE, f"'{R.OBJECT_PROPERTY}'", _I, _N, _N),
    ("region", "r_regionkey = 0", f"'{X}livesIn'", R.RANGE, f"'{R.CLASS}'", _I, _N, _N),
    ("region", "r_regionkey = 0", f"'{X}livesIn'", R.SUBPROPERTY, f"'{X}relatedTo'", _I, _N, _N),
    ("region", "r_regionkey = 0", f"'{X}livesIn'", R.LABEL, "'lives in'", _L, "'en'", _N),
    ("region", "r_regionkey = 0", f"'{X}balance'", R.TYPE, f"'{R.DATATYPE_PROPERTY}'", _I, _N, _N),
    ("region", "r_regionkey = 0", f"'{X}balance'", R.RANGE, f"'{R.XSD}double'", _I, _N, _N),
    ("region", "r_regionkey = 0", f"'{X}note'", R.TYPE, f"'{R.ANNOTATION_PROPERTY}'", _I, _N, _N),
    ("region", "r_regionkey = 0", f"'{X}onto'", R.IMPORTS, "'http://example.org/other'", _I, _N, _N),
    ("customer", "true", f"'{X}customer_' || c_custkey", R.TYPE, f"'{R.INDIVIDUAL}'", _I, _N, _N),
    ("customer", "true", f"'{X}customer_' || c_custkey", R.TYPE, f"'{X}nation_' || c_nationkey", _I, _N, _N),
    ("customer", "true", f"'{X}customer_' || c_custkey", X + "livesIn", f"'{X}nation_' || c_nationkey", _I, _N, _N),
    ("customer", "true", f"'{X}customer_' || c_custkey", X + "balance", "'b' || c_custkey", _L, _N, f"'{R.XSD}string'"),
    ("customer", "c_custkey % 50 = 0", f"'{X}customer_' || c_custkey", X + "livesIn", f"'{X}nowhere'", _I, _N, _N),
    ("customer", "c_custkey % 4 = 0", f"'{X}customer_' || c_custkey", X + "livesIn", f"'{X}region_' || (c_custkey % 5)", _I, _N, _N),
]

_SQL = "t AS (\n" + "\nUNION ALL\n".join(
    f"SELECT {s} AS s, '{p}' AS p, {o} AS o, {k} AS o_type, {lang}::VARCHAR AS o_lang, {dt}::VARCHAR AS o_datatype FROM {tab} WHERE {w}"
    for tab, w, s, p, o, k, lang, dt in _RULES) + ")"


def _triples(spark, sf):
    frames: dict[str, list] = {}
    for tab, w, s, p, o, k, lang, dt in _RULES:
        frames.setdefault(tab, []).append((w, f"named_struct('s', {s}, 'p', '{p}', 'o', {o}, 'o_type', {k}, "
                                              f"'o_lang', cast({lang} as string), 'o_datatype', cast({dt} as string))"))
    # one scan per table: every rule that holds for a row adds one triple
    parts = [table(spark, sf, tab).select(F.explode(F.array_compact(F.array(*[
        F.expr(f"if({w}, {x}, null)") for w, x in rules]))).alias("t")).select("t.*") for tab, rules in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


_NS = "CASE WHEN contains(x, '#') THEN split_part(x, '#', 1) || '#' WHEN contains(x, '/') THEN regexp_extract(x, '^(.*/)', 1) ELSE x END"
_SHORT = "CASE WHEN contains({0}, '#') THEN coalesce(nullif(split_part({0}, '#', 2), ''), split_part({0}, '/', -1)) ELSE coalesce(nullif(split_part({0}, '/', -1), ''), {0}) END"


def _q(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([_SQL, *ctes]) + "\n" + body


@query("onto_counts", _q(f"""
SELECT count(*) AS triples, {', '.join(f"count(*) FILTER (p = '{R.TYPE}' AND o = '{c}') AS {n}" for n, c in (
    ('classes', R.CLASS), ('object_properties', R.OBJECT_PROPERTY), ('datatype_properties', R.DATATYPE_PROPERTY),
    ('annotation_properties', R.ANNOTATION_PROPERTY), ('individuals', R.INDIVIDUAL)))},
 (SELECT count(DISTINCT {_NS}) FROM (SELECT s AS x FROM t UNION ALL SELECT p FROM t)) AS namespaces FROM t"""))
def onto_counts(spark, sf):
    return O.counts(_triples(spark, sf))


@query("onto_profile", _q("SELECT CASE WHEN bool_or(contains(lower(p), 'skos')) THEN 'skos' WHEN bool_or(contains(p, 'owl#')) THEN 'owl' ELSE 'rdf' END AS profile FROM t"))
def onto_profile(spark, sf):
    return O.profile_name(_triples(spark, sf))


def _first(p, n):
    return f"(SELECT min(o) FROM t b WHERE b.s = c.s AND b.p = '{p}') AS {n}"


_CLS = f"c AS (SELECT DISTINCT s FROM t WHERE p = '{R.TYPE}' AND o = '{R.CLASS}')"


def _cnt(end, p, n):
    return f"(SELECT count(*) FROM t b WHERE b.{end} = c.s AND b.p = '{p}') AS {n}"


@query("onto_class_table", _q(f"""SELECT s AS iri, {_first(R.LABEL, 'label')}, {_first(R.COMMENT, 'comment')},
 {_cnt('o', R.SUBCLASS, 'subclasses')}, {_cnt('o', R.TYPE, 'instances')} FROM c""", _CLS))
def onto_class_table(spark, sf):
    return O.class_table(_triples(spark, sf))


@query("onto_property_tables", _q(f"""SELECT k AS kind, s AS iri, {_first(R.LABEL, 'label')}, {_first(R.DOMAIN, 'domain')}, {_first(R.RANGE, 'range')} FROM c""",
 f"c AS (SELECT DISTINCT s, CASE o WHEN '{R.OBJECT_PROPERTY}' THEN 'object' WHEN '{R.DATATYPE_PROPERTY}' THEN 'datatype' ELSE 'annotation' END AS k FROM t WHERE p = '{R.TYPE}' AND o IN ('{R.OBJECT_PROPERTY}', '{R.DATATYPE_PROPERTY}', '{R.ANNOTATION_PROPERTY}'))"))
def onto_property_tables(spark, sf):
    t = _triples(spark, sf)
    kinds = {"object": R.OBJECT_PROPERTY, "datatype": R.DATATYPE_PROPERTY, "annotation": R.ANNOTATION_PROPERTY}
    return reduce(lambda a, b: a.unionByName(b), [O.property_table(t, iri).select(F.lit(k).alias("kind"), "*") for k, iri in kinds.items()])


@query("onto_individuals", _q(f"""SELECT s AS iri, {_first(R.LABEL, 'label')}, (SELECT string_agg(o, ', ' ORDER BY o) FROM t b WHERE b.s = c.s AND b.p = '{R.TYPE}' AND b.o <> '{R.INDIVIDUAL}') AS types FROM c""",
 f"c AS (SELECT DISTINCT s FROM t WHERE p = '{R.TYPE}' AND o = '{R.INDIVIDUAL}')"))
def onto_individuals(spark, sf):
    return O.individuals(_triples(spark, sf))


@query("onto_full_triples", _q("SELECT s, p, o, CASE o_type WHEN 'literal' THEN 'Literal' ELSE 'URI' END AS kind FROM t"))
def onto_full_triples(spark, sf):
    return O.tagged(_triples(spark, sf))


@query("onto_hierarchy", _q(f"""SELECT s AS iri, coalesce((SELECT string_agg(o, ' | ' ORDER BY o) FROM t b WHERE b.s = c.s AND b.p = '{R.SUBCLASS}'), '') AS supers,
 coalesce((SELECT string_agg(s, ' | ' ORDER BY s) FROM t b WHERE b.o = c.s AND b.p = '{R.SUBCLASS}'), '') AS subs FROM c""", _CLS))
def onto_hierarchy(spark, sf):
    return O.hierarchy(_triples(spark, sf))


@query("onto_domains_ranges", _q(f"""SELECT s AS iri, coalesce((SELECT string_agg(o, ' | ' ORDER BY o) FROM t b WHERE b.s = c.s AND b.p = '{R.DOMAIN}'), '') AS domains,
 coalesce((SELECT string_agg(o, ' | ' ORDER BY o) FROM t b WHERE b.s = c.s AND b.p = '{R.RANGE}'), '') AS ranges FROM c""",
 f"c AS (SELECT DISTINCT s FROM t WHERE p = '{R.TYPE}' AND o IN ('{R.OBJECT_PROPERTY}', '{R.DATATYPE_PROPERTY}'))"))
def onto_domains_ranges(spark, sf):
    return O.domains_ranges(_triples(spark, sf))


_CLOSURE = f"""e AS (SELECT DISTINCT s, o FROM t WHERE p = '{R.SUBCLASS}'),
 e2 AS (SELECT s, o FROM e UNION SELECT a.s, b.o FROM e a JOIN e b ON a.o = b.s),
 e3 AS (SELECT s, o FROM e2 UNION SELECT a.s, b.o FROM e2 a JOIN e2 b ON a.o = b.s)"""


@query("onto_subclass_one_hop", _q("SELECT s, o, (s, o) NOT IN (SELECT (s, o) FROM e) AS inferred FROM e2", _CLOSURE))
def onto_subclass_one_hop(spark, sf):
    return O.materialise_subclasses(_triples(spark, sf)).filter(F.col("p") == R.SUBCLASS).select("s", "o", "inferred")


@query("onto_subclass_closure", _q("SELECT s AS src, o AS dst FROM e3", _CLOSURE))
def onto_subclass_closure(spark, sf):
    return O.subclass_closure(_triples(spark, sf))


_EQ = f"""q1 AS (SELECT s, o FROM t WHERE p = '{R.EQUIVALENT_CLASS}' UNION SELECT o, s FROM t WHERE p = '{R.EQUIVALENT_CLASS}'),
 q2 AS (SELECT s, o FROM q1 UNION SELECT a.s, b.o FROM q1 a JOIN q1 b ON a.o = b.s),
 q3 AS (SELECT s, o FROM q2 UNION SELECT a.s, b.o FROM q2 a JOIN q2 b ON a.o = b.s)"""


@query("onto_equivalent_classes", _q(f"SELECT s, o, (s, o) NOT IN (SELECT (s, o) FROM t WHERE p = '{R.EQUIVALENT_CLASS}') AS inferred FROM q3 WHERE s <> o", _EQ))
def onto_equivalent_classes(spark, sf):
    return O.materialise_equivalents(_triples(spark, sf)).filter(F.col("p") == R.EQUIVALENT_CLASS).select("s", "o", "inferred")


@query("onto_namespace_filter", _q(f"SELECT s, p, o FROM t WHERE starts_with(s, '{R.RDFS}') OR starts_with(p, '{R.RDFS}')"))
def onto_namespace_filter(spark, sf):
    return O.in_namespace(_triples(spark, sf), R.RDFS).select("s", "p", "o")


@query("onto_without_annotations", _q(f"SELECT s, p, o FROM t WHERE NOT (p = '{R.TYPE}' AND o = '{R.ANNOTATION_PROPERTY}')"))
def onto_without_annotations(spark, sf):
    return O.without_annotation_declarations(_triples(spark, sf)).select("s", "p", "o")


@query("onto_asserted_only", _q("SELECT s, p, o FROM t"))
def onto_asserted_only(spark, sf):
    return O.asserted_only(O.propagate_types(_triples(spark, sf))).select("s", "p", "o")


@query("onto_type_propagation", _q(f"""SELECT DISTINCT a.s, e.o FROM t a JOIN e ON a.o = e.s WHERE a.p = '{R.TYPE}'""", _CLOSURE))
def onto_type_propagation(spark, sf):
    return O.propagate_types(_triples(spark, sf)).filter("inferred").select("s", "o")


@query("onto_rdfs_closure", _q(f"""
SELECT p, count(*) AS n FROM (
 SELECT s, p, o FROM f UNION SELECT s, '{R.TYPE}', o FROM a UNION SELECT s, '{R.SUBCLASS}', o FROM e3) GROUP BY p""",
 _CLOSURE, f"f AS (SELECT s, p, o FROM t UNION SELECT s, '{X}relatedTo', o FROM t WHERE p = '{X}livesIn')",
 f"""y AS (SELECT s, o FROM f WHERE p = '{R.TYPE}' UNION SELECT f.s, d.o FROM f JOIN t d ON d.s = f.p AND d.p = '{R.DOMAIN}'
  UNION SELECT f.o, d.o FROM f JOIN t d ON d.s = f.p AND d.p = '{R.RANGE}' WHERE f.p <> '{X}balance')""",
 "a AS (SELECT s, o FROM y UNION SELECT y.s, e3.o FROM y JOIN e3 ON y.o = e3.s)"))
def onto_rdfs_closure(spark, sf):
    return O.rdfs_closure(_triples(spark, sf)).select("s", "p", "o").distinct().groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def _viol(rule, end):
    return f"""SELECT DISTINCT s, p, o FROM t u WHERE p IN (SELECT s FROM t WHERE p = '{rule}') AND p IN (SELECT s FROM t WHERE p = '{R.TYPE}' AND o = '{R.OBJECT_PROPERTY}')
 AND NOT EXISTS (SELECT 1 FROM t d JOIN t y ON y.o = d.o AND y.p = '{R.TYPE}' WHERE d.s = u.p AND d.p = '{rule}' AND y.s = u.{end})"""


@query("onto_domain_violations", _q(_viol(R.DOMAIN, "s")))
def onto_domain_violations(spark, sf):
    return O.violations(_triples(spark, sf))


@query("onto_range_violations", _q(_viol(R.RANGE, "o")))
def onto_range_violations(spark, sf):
    return O.violations(_triples(spark, sf), "range")


@query("onto_class_statistics", _q(f"""SELECT iri, instances, subclasses, superclasses, in_domain, in_range,
 instances + subclasses + superclasses + in_domain + in_range AS total FROM (SELECT s AS iri, {_cnt('o', R.TYPE, 'instances')}, {_cnt('o', R.SUBCLASS, 'subclasses')},
 {_cnt('s', R.SUBCLASS, 'superclasses')}, {_cnt('o', R.DOMAIN, 'in_domain')}, {_cnt('o', R.RANGE, 'in_range')} FROM c)""", _CLS))
def onto_class_statistics(spark, sf):
    return O.class_statistics(_triples(spark, sf))


@query("onto_type_columns", _q(f"""SELECT s, max((o = '{R.CLASS}')::INT) AS "type_Class", max((o = '{R.INDIVIDUAL}')::INT) AS "type_NamedIndividual",
 max((o = '{X}nation_0')::INT) AS type_nation_0 FROM t WHERE p = '{R.TYPE}' GROUP BY s"""))
def onto_type_columns(spark, sf):
    return O.type_columns(_triples(spark, sf)).select("s", "type_Class", "type_NamedIndividual", "type_nation_0")


@query("onto_label_tfidf", _q("""SELECT s, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY s)), 7) AS weight FROM x""",
 f"d AS (SELECT s, string_agg(o, ' ' ORDER BY o) AS txt FROM t WHERE p = '{R.LABEL}' GROUP BY 1)",
 "k AS (SELECT s, unnest(regexp_extract_all(lower(txt), '[\\p{L}\\p{M}\\p{N}_]{2,}')) AS term FROM d)",
 "v AS (SELECT term FROM k GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 50)",
 "tf AS (SELECT s, term, count(*) AS tf FROM k JOIN v USING (term) GROUP BY 1, 2)",
 "x AS (SELECT s, term, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM d)) / (1.0 + count(*) OVER (PARTITION BY term))) + 1) AS w FROM tf)"))
def onto_label_tfidf(spark, sf):
    labels = (_triples(spark, sf).filter(F.col("p") == R.LABEL).groupBy("s")
              .agg(F.array_join(F.sort_array(F.collect_list("o")), " ").alias("txt")))
    return TF.tfidf(labels, "s", "txt", 50).withColumn("weight", F.round("weight", 7))


@query("onto_top_terms", _q(f"""SELECT * FROM (SELECT 'namespace' AS what, {_NS} AS term, count(*) AS n FROM (SELECT s AS x FROM t UNION ALL SELECT p FROM t) GROUP BY 2 ORDER BY n DESC, term LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'predicate', p AS term, count(*) AS n FROM t GROUP BY 2 ORDER BY n DESC, term LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'subject', s AS term, count(*) AS n FROM t GROUP BY 2 ORDER BY n DESC, term LIMIT 20)"""))
def onto_top_terms(spark, sf):
    t = _triples(spark, sf)
    return reduce(lambda a, b: a.unionByName(b), [O.top_terms(t, w).select(F.lit(w).alias("what"), "*") for w in ("namespace", "predicate", "subject")])


@query("onto_density", _q("""SELECT count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT p) AS predicates, count(DISTINCT o) AS objects,
 count(*)::DOUBLE / (count(DISTINCT s) * count(DISTINCT p)) AS density FROM t"""))
def onto_density(spark, sf):
    return O.density(_triples(spark, sf))


@query("onto_browse", _q(f"SELECT s, p, o FROM t WHERE p = '{X}livesIn' AND contains(lower(s), 'customer_1') ORDER BY 1, 2, 3 LIMIT 500"))
def onto_browse(spark, sf):
    return O.browse(_triples(spark, sf), X + "livesIn", "Customer_1")


@query("onto_relation_edges", _q(f"""SELECT s AS src, o AS dst, {_SHORT.format('p')} AS label FROM t WHERE p IN ('{X}livesIn', '{R.SUBCLASS}') AND s <> o AND o_type <> 'literal'"""))
def onto_relation_edges(spark, sf):
    return O.relation_edges(_triples(spark, sf), [X + "livesIn", R.SUBCLASS])


@query("onto_hierarchy_edges", _q("""SELECT o AS parent, s AS child, CASE WHEN o IN (SELECT s FROM e) THEN 'middle' ELSE 'root' END AS parent_role,
 CASE WHEN s IN (SELECT o FROM e) THEN 'middle' ELSE 'leaf' END AS child_role FROM e""", _CLOSURE))
def onto_hierarchy_edges(spark, sf):
    return O.hierarchy_edges(_triples(spark, sf))


_SCORE = "CASE " + " ".join(f"WHEN {_SHORT.format('p')} = '{n}' THEN {len(R.SEMANTIC_PREDICATES) - i}" for i, n in enumerate(R.SEMANTIC_PREDICATES)) \
    + " WHEN p IN (" + ", ".join(f"'{m}'" for m in R.META_PREDICATES) + ") THEN 0 ELSE 1 END"


@query("onto_schema_preview", _q(f"""SELECT {_SHORT.format('s')} AS subject, {_SHORT.format('p')} AS predicate, CASE WHEN o_type = 'literal' THEN o ELSE {_SHORT.format('o')} END AS object, score FROM (
 SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, p, o) i FROM x WHERE s IN (SELECT s FROM x GROUP BY s ORDER BY sum(score) DESC, s LIMIT 8)) WHERE i <= 3""",
 f"x AS (SELECT *, ({_SCORE})::BIGINT AS score FROM t)"))
def onto_schema_preview(spark, sf):
    return O.schema_preview(_triples(spark, sf))


@query("onto_triple_preview", _q(f"""SELECT subject, predicate, object FROM (SELECT {_SHORT.format('s')} AS subject, {_SHORT.format('p')} AS predicate,
 CASE WHEN o_type = 'literal' THEN o ELSE {_SHORT.format('o')} END AS object FROM t WHERE p NOT IN ({', '.join(f"'{m}'" for m in R.META_PREDICATES)}))
 ORDER BY (predicate NOT IN ({', '.join(f"'{m}'" for m in R.SEMANTIC_PREDICATES)}))::INT, predicate, subject, object LIMIT 50"""))
def onto_triple_preview(spark, sf):
    return O.triple_preview(_triples(spark, sf))


@query("onto_merge_graphs", _q(f"SELECT DISTINCT s, p, o, o_lang FROM t WHERE s NOT LIKE '%customer_1%' OR p = '{R.TYPE}'"))
def onto_merge_graphs(spark, sf):
    t = _triples(spark, sf)
    a, b = t.filter("s not like '%customer_1%'"), t.filter(F.col("p") == R.TYPE)
    return O.union_graphs(a, b).select("s", "p", "o", "o_lang")


@query("onto_remap_import", _q(f"""SELECT s, p, CASE WHEN p = '{R.IMPORTS}' THEN 'http://example.org/mine' ELSE o END AS o FROM t"""))
def onto_remap_import(spark, sf):
    return O.remap_import(_triples(spark, sf), "http://example.org/other", new_iri="http://example.org/mine").select("s", "p", "o")


@query("onto_short_names", _q(f"""SELECT s, {_SHORT.format('s')} AS short, split_part(s, '#', 1) || '#' AS ns, CASE WHEN o_type = 'literal' THEN o ELSE {_SHORT.format('o')} END AS obj FROM t"""))
def onto_short_names(spark, sf):
    return _triples(spark, sf).select("s", R.short_name(F.col("s")).alias("short"), R.namespace(F.col("s")).alias("ns"),
                                      R.short_name(F.col("o"), F.col("o_type")).alias("obj"))


@query("onto_to_graph", _q("SELECT s AS src, o AS dst, p AS label FROM t WHERE o_type <> 'literal'"))
def onto_to_graph(spark, sf):
    return G.from_triples(_triples(spark, sf))


# property graphs: customers and the parts they ordered ------------------------------------------------

_EDGES = "e AS (SELECT DISTINCT o_custkey || 'c' AS src, l_partkey || 'p' AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_DEG = "d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1)"


def _edges(spark, sf):
    return (table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.expr("o_orderkey = l_orderkey"))
            .select(F.expr("o_custkey || 'c' as src"), F.expr("l_partkey || 'p' as dst")))


@query("graph_summary", f"""WITH {_EDGES}, {_DEG} SELECT count(*) AS nodes, (SELECT count(*) FROM e) AS edges, false AS directed,
 round(2.0::DOUBLE * (SELECT count(*) FROM e) / (count(*)::DOUBLE * (count(*) - 1)), 10) AS density, round(avg(degree), 8) AS mean_degree, max(degree) AS max_degree FROM d""")
def graph_summary(spark, sf):
    return G.summary(_edges(spark, sf)).withColumns({"density": F.round("density", 10), "mean_degree": F.round("mean_degree", 8)})


@query("graph_degree_histogram", f"""WITH {_EDGES}, {_DEG}, s AS (SELECT min(degree) lo, max(degree) hi FROM d)
SELECT least(floor((degree - lo) / ((hi - lo) / 30.0::DOUBLE)), 29)::BIGINT AS bin, count(*) AS n FROM d, s GROUP BY 1""")
def graph_degree_histogram(spark, sf):
    return G.degree_histogram(_edges(spark, sf)).select("bin", "n")


@query("graph_top_degree", f"WITH {_EDGES}, {_DEG} SELECT id, degree FROM d ORDER BY degree DESC, id LIMIT 15")
def graph_top_degree(spark, sf):
    return G.top_degree(_edges(spark, sf))


@query("graph_node_features", f"WITH {_EDGES}, {_DEG} SELECT id, degree, round(degree / ((SELECT count(*) FROM d) - 1.0::DOUBLE), 10) AS centrality FROM d")
def graph_node_features(spark, sf):
    return G.node_features(_edges(spark, sf)).withColumn("centrality", F.round("centrality", 10))


@query("graph_adjacency", """SELECT n_regionkey AS src, c_mktsegment AS dst, count(*) AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def graph_adjacency(spark, sf):
    return G.adjacency(_segments(spark, sf))


def _segments(spark, sf):
    return table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.expr("c_nationkey = n_nationkey")).select(
        F.col("n_regionkey").alias("src"), F.col("c_mktsegment").alias("dst"))


@query("graph_adjacency_matrix", """SELECT n_regionkey AS src, """ + ", ".join(f"count(*) FILTER (c_mktsegment = '{v}') AS \"{v}\"" for v in (
    "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def graph_adjacency_matrix(spark, sf):
    return G.adjacency(_segments(spark, sf), wide=True)


@query("graph_subgraph", f"""WITH {_EDGES}, n AS (SELECT src AS id FROM e UNION SELECT dst FROM e ORDER BY id LIMIT 1500)
SELECT src, dst FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""")
def graph_subgraph(spark, sf):
    return G.subgraph(G.simple_edges(_edges(spark, sf), directed=True), 1500)


# every order hangs on its customer, customers form chains of five
_CHAIN = """e AS (SELECT o_custkey AS src, 1000000000 + o_orderkey AS dst FROM orders UNION ALL SELECT c_custkey, c_custkey + 1 FROM customer WHERE c_custkey % 5 < 4),
 l AS (SELECT src AS id, src - src % 5 AS component FROM e UNION SELECT dst, src - src % 5 FROM e)"""


def _chains(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), F.expr("1000000000 + o_orderkey as dst"))
    return a.unionByName(table(spark, sf, "customer").filter("c_custkey % 5 < 4").select(
        F.col("c_custkey").alias("src"), F.expr("c_custkey + 1 as dst")))


@query("graph_components", f"WITH {_CHAIN} SELECT id, component FROM l")
def graph_components(spark, sf):
    return G.connected_components(_chains(spark, sf))
