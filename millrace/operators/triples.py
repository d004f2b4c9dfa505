"""RDF triples as a table (s, p, o, o_type, o_lang, o_datatype): counts, tables, rules and checks.

``o_type`` is iri, literal or blank. A look-up per entity is a left join of an aggregate; schema facts
(domains, ranges, subclasses) are read from the triples themselves and joined as tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.functions import terms as R
from millrace.operators.graph import connected_components
from millrace.plans.lineage import cut
from millrace.plans.lookup import fit_lookup, join_lookup

COLUMNS = ["s", "p", "o", "o_type", "o_lang", "o_datatype"]


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by keys that are nearly unique, ahead of a grouping by them: combining in the scan would hold all keys of a split,
    and a split of a few MB may hold millions of triples. The parts are sized by what is shuffled."""
    return df.repartition(*keys)


def union_graphs(*graphs: DataFrame) -> DataFrame:
    """Set union on all term fields."""
    out = graphs[0].select(*COLUMNS)
    for g in graphs[1:]:
        out = out.unionByName(g.select(*COLUMNS))
    return _dealt(out, COLUMNS).dropDuplicates(COLUMNS)


def typed(t: DataFrame, cls: str) -> DataFrame:
    """Distinct subjects with ``rdf:type cls``."""
    return t.filter((F.col("p") == R.TYPE) & (F.col("o") == cls)).select("s").distinct()


def counts(t: DataFrame) -> DataFrame:
    """(triples, classes, object_properties, datatype_properties, annotation_properties, individuals,
    namespaces) in one row."""
    def of(cls):
        return F.coalesce(F.sum((F.col("o") == cls).cast("long")), zero)
    spaces = t.select(F.explode(F.array(R.namespace(F.col("s")), R.namespace(F.col("p")))).alias("ns")).groupBy("ns").agg(F.count(F.lit(1)).alias("n"))
    ns, ends = spaces.agg(F.count(F.lit(1)), F.sum("n")).first()   # a triple has two
    triples = F.lit(None if ends is None else ends // 2).cast("long")
    zero = F.lit(None if ends is None else 0).cast("long")
    kinds = [R.CLASS, R.OBJECT_PROPERTY, R.DATATYPE_PROPERTY, R.ANNOTATION_PROPERTY, R.INDIVIDUAL]
    # only what the counted types say must be distinct
    declared = _dealt(t.filter((F.col("p") == R.TYPE) & F.col("o").isin(kinds)).select("s", "o"), ["s", "o"]).distinct()
    names = ["classes", "object_properties", "datatype_properties", "annotation_properties", "individuals"]
    return (declared.agg(*[of(k).alias(n) for k, n in zip(kinds, names)])
            .select(triples.alias("triples"), *names, F.lit(ns).cast("long").alias("namespaces")))


def profile_name(t: DataFrame) -> DataFrame:
    """skos > owl > rdfs > rdf > generic, by the predicates in use."""
    p = F.col("p")
    s = t.select("p").distinct().agg(
        F.coalesce(F.bool_or(F.lower(p).contains("skos")), F.lit(False)).alias("skos"),
        F.coalesce(F.bool_or(p.contains("owl#")), F.lit(False)).alias("owl"),
        F.coalesce(F.bool_or(p.contains("rdfs#") | p.contains("rdf-schema")), F.lit(False)).alias("rdfs"),
        F.coalesce(F.bool_or(p.contains("rdf-syntax")), F.lit(False)).alias("rdf"))
    name = F.lit("generic")
    for k in ("rdf", "rdfs", "owl", "skos"):
        name = F.when(F.col(k), k).otherwise(name)
    return s.select(name.alias("profile"))


def first_object(t: DataFrame, predicate: str, name: str) -> DataFrame:
    """(s, name): the smallest object of a predicate per subject."""
    return t.filter(F.col("p") == predicate).groupBy("s").agg(F.min("o").alias(name))


def count_by_subject(t: DataFrame, predicate: str, name: str) -> DataFrame:
    return t.filter(F.col("p") == predicate).groupBy("s").agg(F.count(F.lit(1)).alias(name))


def count_by_object(t: DataFrame, predicate: str, name: str) -> DataFrame:
    return (t.filter(F.col("p") == predicate).groupBy(F.col("o").alias("s")).agg(F.count(F.lit(1)).alias(name)))


def class_table(t: DataFrame, limit: int | None = None) -> DataFrame:
    """(iri, label, comment, subclasses, instances) per declared class, by IRI."""
    base = typed(t, R.CLASS)
    if limit:
        base = base.orderBy("s").limit(limit)
    out = (base.join(first_object(t, R.LABEL, "label"), "s", "left").join(first_object(t, R.COMMENT, "comment"), "s", "left")
           .join(count_by_object(t, R.SUBCLASS, "subclasses"), "s", "left")
           .join(count_by_object(t, R.TYPE, "instances"), "s", "left"))
    return out.fillna(0, ["subclasses", "instances"]).withColumnRenamed("s", "iri")


def property_table(t: DataFrame, kind: str) -> DataFrame:
    """(iri, label, domain, range) of object, datatype or annotation properties."""
    base = typed(t, kind)
    return (base.join(first_object(t, R.LABEL, "label"), "s", "left").join(first_object(t, R.DOMAIN, "domain"), "s", "left")
            .join(first_object(t, R.RANGE, "range"), "s", "left").withColumnRenamed("s", "iri"))


def individuals(t: DataFrame, max_types: int | None = None) -> DataFrame:
    """(iri, label, types): declared individuals with their class types in sorted order, the first ``max_types`` of them if given."""
    ind = typed(t, R.INDIVIDUAL)
    types = (t.filter((F.col("p") == R.TYPE) & (F.col("o") != R.INDIVIDUAL)).join(ind, "s", "left_semi")
             .groupBy("s").agg(F.array_join(F.slice(F.sort_array(F.collect_set("o")), 1, max_types or 2 ** 31 - 1), ", ").alias("types")))
    return (ind.join(first_object(t, R.LABEL, "label"), "s", "left").join(types, "s", "left").withColumnRenamed("s", "iri"))


def tagged(t: DataFrame) -> DataFrame:
    """(s, p, o, kind): Literal, URI or Blank for every triple."""
    kind = F.when(F.col("o_type") == "literal", "Literal").when(F.col("o_type") == "blank", "Blank").otherwise("URI")
    return t.select("s", "p", "o", kind.alias("kind"))


def hierarchy(t: DataFrame) -> DataFrame:
    """(iri, supers, subs): direct super- and subclasses, sorted and joined by `` | ``."""
    sub = t.filter(F.col("p") == R.SUBCLASS)
    up = sub.groupBy("s").agg(_joined("o").alias("supers"))
    down = sub.groupBy(F.col("o").alias("s")).agg(_joined("s").alias("subs"))
    return typed(t, R.CLASS).join(up, "s", "left").join(down, "s", "left").fillna("", ["supers", "subs"]).withColumnRenamed("s", "iri")


def _joined(col: str) -> Column:
    return F.array_join(F.sort_array(F.collect_set(col)), " | ")


def domains_ranges(t: DataFrame) -> DataFrame:
    """(iri, domains, ranges) of every object and datatype property."""
    props = typed(t, R.OBJECT_PROPERTY).unionByName(typed(t, R.DATATYPE_PROPERTY)).distinct()
    lists = [t.filter(F.col("p") == p).groupBy("s").agg(_joined("o").alias(n)) for p, n in ((R.DOMAIN, "domains"), (R.RANGE, "ranges"))]
    return (props.join(lists[0], "s", "left").join(lists[1], "s", "left").fillna("", ["domains", "ranges"]).withColumnRenamed("s", "iri"))


# rules ------------------------------------------------------------------------------------------------

def _iri(s: Column, p: str, o: Column) -> list[Column]:
    return [s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("iri").alias("o_type"),
            F.lit(None).cast("string").alias("o_lang"), F.lit(None).cast("string").alias("o_datatype")]


def transitive_closure(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """All (src, dst) reachable in one or more steps; cycles are fine, and make a node reach itself.

    Semi-naive: a round joins only the pairs that the last round found (their shortest paths are longer than half of the
    longest so far) to all known ones, so a pair is extended once and paths of length L take log2(L) rounds. A round reads one table and
    writes the next. Meant for schema edges.
    """
    known = cut(edges.select("src", "dst").distinct().withColumn("new", F.lit(True)))
    for _ in range(max_rounds):
        last = known.filter("new").select(F.col("src").alias("a"), F.col("dst").alias("src"))
        step = last.join(known.select("src", "dst"), "src").select(F.col("a").alias("src"), "dst", F.lit(True).alias("new"))
        # a pair is new if no row of it was known before
        known = cut(known.select("src", "dst", F.lit(False).alias("new")).unionByName(step).groupBy("src", "dst").agg(F.bool_and("new").alias("new")))
        if known.filter("new").isEmpty():
            return known.select("src", "dst")
    raise RuntimeError("closure did not settle")


def subclass_closure(t: DataFrame, full: bool = True) -> DataFrame:
    """(src, dst) derived from rdfs:subClassOf: every level, or one hop beyond the asserted ones."""
    edges = t.filter(F.col("p") == R.SUBCLASS).select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct()
    if full:
        return transitive_closure(edges)
    hop = edges.select(F.col("src").alias("a"), F.col("dst").alias("src")).join(edges, "src").select(F.col("a").alias("src"), "dst")
    return edges.unionByName(hop).distinct()


def with_inferred(t: DataFrame, derived: DataFrame) -> DataFrame:
    """The triples plus the derived ones that were not asserted, with an ``inferred`` mark."""
    known = t.select("s", "p", "o").hint("merge")   # a few MB of files may hold GBs of triples: never collected for a broadcast
    new = derived.select(*COLUMNS).distinct().join(known, ["s", "p", "o"], "left_anti").select(*COLUMNS)
    return t.select(*COLUMNS).withColumn("inferred", F.lit(False)).unionByName(new.withColumn("inferred", F.lit(True)))


def materialise_subclasses(t: DataFrame, closure: bool = False) -> DataFrame:
    d = subclass_closure(t, closure)
    return with_inferred(t, d.select(*_iri(F.col("src"), R.SUBCLASS, F.col("dst"))))


def materialise_equivalents(t: DataFrame, ways: int = 16) -> DataFrame:
    """owl:equivalentClass made symmetric and transitive (a class is not stated equivalent to itself).

    Components first, then the pairs of each: the work is the size of the answer. A component's pairs are dealt over ``ways`` tasks.
    """
    e = t.filter(F.col("p") == R.EQUIVALENT_CLASS).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    of = cut(connected_components(e))
    left = of.select(F.col("id").alias("src"), "component", F.pmod(F.xxhash64("id"), F.lit(ways)).alias("way"))
    right = of.select(F.col("id").alias("dst"), "component", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ways - 1).cast("long"))).alias("way"))
    closed = left.join(right, ["component", "way"]).filter("src <> dst").select("src", "dst")
    return with_inferred(t, closed.select(*_iri(F.col("src"), R.EQUIVALENT_CLASS, F.col("dst"))))


def asserted_only(t: DataFrame) -> DataFrame:
    return t.filter(~F.col("inferred"))


def in_namespace(t: DataFrame, ns: str) -> DataFrame:
    return t.filter(F.col("s").startswith(ns) | F.col("p").startswith(ns))


def without_annotation_declarations(t: DataFrame) -> DataFrame:
    return t.filter(~((F.col("p") == R.TYPE) & (F.col("o") == R.ANNOTATION_PROPERTY)))


def _mapped_pairs(facts: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Join facts to a rule table (key, target); the rule table is measured, hot keys are split off."""
    grouped = rules.groupBy(key).agg(F.collect_set("target").alias("targets"), F.count(F.lit(1)).alias("n"))
    return (join_lookup(facts, fit_lookup(grouped, [key]), ["targets"])
            .withColumn("target", F.explode("targets")).drop("targets"))


def propagate_types(t: DataFrame, closure: bool = False) -> DataFrame:
    """x type C, C subClassOf D gives x type D: one hop, or along the whole hierarchy."""
    types = t.filter(F.col("p") == R.TYPE).select("s", F.col("o").alias("cls"))
    if closure:
        rules = subclass_closure(t)
    else:
        rules = t.filter(F.col("p") == R.SUBCLASS).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    pairs = _mapped_pairs(types, rules.select(F.col("src").alias("cls"), F.col("dst").alias("target")).distinct(), "cls")
    return with_inferred(t, pairs.select(*_iri(F.col("s"), R.TYPE, F.col("target"))))


def rdfs_closure(t: DataFrame) -> DataFrame:
    """RDFS rules 2, 3, 5, 7, 9 and 11. Schema closures first, then the facts once per
    kind of rule: subproperties, then domains and ranges, then types along the class hierarchy."""
    sub = t.filter(F.col("p") == R.SUBPROPERTY).select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct()
    props = transitive_closure(sub)
    classes = subclass_closure(t)
    up = _mapped_pairs(t, props.select(F.col("src").alias("p"), F.col("dst").alias("target")), "p")
    # facts and types are read by several rules; written once, the plan does not repeat what they come from
    facts = cut(t.select(*COLUMNS).unionByName(up.drop("p").withColumnRenamed("target", "p").select(*COLUMNS)).distinct())
    dom = t.filter(F.col("p") == R.DOMAIN).select(F.col("s").alias("p"), F.col("o").alias("target")).distinct()
    ran = t.filter(F.col("p") == R.RANGE).select(F.col("s").alias("p"), F.col("o").alias("target")).distinct()
    by_domain = _mapped_pairs(facts, dom, "p").select("s", F.col("target").alias("cls"))
    by_range = _mapped_pairs(facts.filter("o_type <> 'literal'"), ran, "p").select(F.col("o").alias("s"), F.col("target").alias("cls"))
    direct = facts.filter(F.col("p") == R.TYPE).select("s", F.col("o").alias("cls"))
    types = cut(direct.unionByName(by_domain).unionByName(by_range).distinct())
    above = _mapped_pairs(types, classes.select(F.col("src").alias("cls"), F.col("dst").alias("target")), "cls")
    all_types = types.unionByName(above.select("s", F.col("target").alias("cls"))).distinct()
    derived = (facts.unionByName(all_types.select(*_iri(F.col("s"), R.TYPE, F.col("cls"))))
               .unionByName(classes.select(*_iri(F.col("src"), R.SUBCLASS, F.col("dst"))))
               .unionByName(props.select(*_iri(F.col("src"), R.SUBPROPERTY, F.col("dst")))))
    return with_inferred(t, derived)


def violations(t: DataFrame, side: str = "domain") -> DataFrame:
    """(s, p, o): uses of an object property whose subject (or object) has none of its domains (ranges)."""
    rule = R.DOMAIN if side == "domain" else R.RANGE
    end = "s" if side == "domain" else "o"
    allowed = (t.filter(F.col("p") == rule).select(F.col("s").alias("p"), F.col("o").alias("cls"))
               .join(typed(t, R.OBJECT_PROPERTY).withColumnRenamed("s", "p"), "p", "left_semi"))
    lists = allowed.groupBy("p").agg(F.collect_set("cls").alias("allowed"), F.count(F.lit(1)).alias("n"))
    uses = join_lookup(t.select("s", "p", "o"), fit_lookup(lists, ["p"]), ["allowed"]).filter("allowed is not null")
    # an entity has few types; the join is on (entity, one allowed class) so that no entity list is built
    wanted = uses.withColumn("cls", F.explode("allowed"))
    types = t.filter(F.col("p") == R.TYPE).select(F.col("s").alias(end), F.col("o").alias("cls"))
    good = wanted.join(types, [end, "cls"], "left_semi").select("s", "p", "o").distinct()
    return uses.select("s", "p", "o").distinct().join(good, ["s", "p", "o"], "left_anti")


# statistics and views ---------------------------------------------------------------------------------

def class_statistics(t: DataFrame) -> DataFrame:
    """(iri, instances, subclasses, superclasses, in_domain, in_range, total) per class."""
    parts = [count_by_object(t, R.TYPE, "instances"), count_by_object(t, R.SUBCLASS, "subclasses"),
             count_by_subject(t, R.SUBCLASS, "superclasses"), count_by_object(t, R.DOMAIN, "in_domain"),
             count_by_object(t, R.RANGE, "in_range")]
    names = ["instances", "subclasses", "superclasses", "in_domain", "in_range"]
    out = typed(t, R.CLASS)
    for p in parts:
        out = out.join(p, "s", "left")
    out = out.fillna(0, names)
    return out.withColumn("total", sum([F.col(n) for n in names], F.lit(0))).withColumnRenamed("s", "iri")


MAX_TYPE_COLUMNS = 2000   # beyond it a frame of columns is refused, not cut


def type_columns(t: DataFrame, limit: int | None = None) -> DataFrame:
    """One 0/1 column per type (the first ``limit`` in sorted order if given), one row per typed entity.

    Types that share a short name get a numbered suffix.
    """
    types = t.filter(F.col("p") == R.TYPE)
    found = types.select("o").distinct().orderBy("o")
    names = [r[0] for r in (found.limit(limit) if limit else found.limit(MAX_TYPE_COLUMNS + 1)).collect()]
    if not limit and len(names) > MAX_TYPE_COLUMNS:
        raise ValueError(f"more than {MAX_TYPE_COLUMNS} types: give a limit or keep the types as rows")
    out, used = [], {}
    for n in names:
        base = n.rsplit("#", 1)[-1] if "#" in n else n.rsplit("/", 1)[-1]
        used[base] = used.get(base, 0) + 1
        col = base if used[base] == 1 else f"{base}_{used[base]}"
        out.append(F.max((F.col("o") == n).cast("int")).alias(f"type_{col}"))
    return types.groupBy("s").agg(*out)


def top_terms(t: DataFrame, what: str = "namespace", n: int = 20) -> DataFrame:
    """(term, n): the most frequent namespaces, predicates or subjects."""
    if what == "namespace":
        rows = t.select(F.explode(F.array(R.namespace(F.col("s")), R.namespace(F.col("p")))).alias("term"))
    else:
        rows = t.select(F.col("p" if what == "predicate" else "s").alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(n)


def density(t: DataFrame) -> DataFrame:
    """(triples, subjects, predicates, objects, density): triples over subjects × predicates."""
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in ("s", "p", "o")])
    uniq = t.select(F.explode(cells).alias("c")).groupBy("c.k", "c.v").agg(F.count(F.lit(1)).alias("n"))
    def of(k):
        return F.sum((F.col("k") == k).cast("long"))
    row = uniq.agg(F.sum(F.when(F.col("k") == "p", F.col("n"))).alias("triples"), of("s").alias("subjects"),
                   of("p").alias("predicates"), of("o").alias("objects"))
    return row.withColumn("density", F.try_divide(F.col("triples").cast("double"), F.col("subjects") * F.col("predicates")))


def browse(t: DataFrame, predicate: str | None = None, subject_contains: str | None = None, limit: int = 500) -> DataFrame:
    out = t
    if predicate:
        out = out.filter(F.col("p") == predicate)
    if subject_contains:
        out = out.filter(F.lower("s").contains(subject_contains.lower()))
    return out.select("s", "p", "o").orderBy("s", "p", "o").limit(limit)


def relation_edges(t: DataFrame, predicates: list[str], limit: int | None = None) -> DataFrame:
    """(src, dst, label) of the allowed predicates, without self loops and literals."""
    e = (t.filter(F.col("p").isin(predicates) & (F.col("s") != F.col("o")) & (F.col("o_type") != "literal"))
         .select(F.col("s").alias("src"), F.col("o").alias("dst"), R.short_name(F.col("p")).alias("label")))
    return e.orderBy("src", "dst", "label").limit(limit) if limit else e


def hierarchy_edges(t: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """(parent, child, parent_role, child_role) with roles root, middle, leaf; among the first ``max_nodes`` nodes if given."""
    e = t.filter((F.col("p") == R.SUBCLASS) & (F.col("o_type") == "iri")).select(F.col("o").alias("parent"), F.col("s").alias("child")).distinct()
    if max_nodes:
        nodes = e.select(F.explode(F.array("parent", "child")).alias("node")).distinct().orderBy("node").limit(max_nodes)
        e = (e.join(F.broadcast(nodes.withColumnRenamed("node", "parent")), "parent", "left_semi")
             .join(F.broadcast(nodes.withColumnRenamed("node", "child")), "child", "left_semi"))
    child_of = e.select(F.col("child").alias("parent")).distinct().withColumn("_mid", F.lit(1))
    parent_of = e.select(F.col("parent").alias("child")).distinct().withColumn("_inner", F.lit(1))
    out = e.join(child_of, "parent", "left").join(parent_of, "child", "left")
    return out.select("parent", "child", F.when(F.col("_mid").isNull(), "root").otherwise("middle").alias("parent_role"),
                      F.when(F.col("_inner").isNull(), "leaf").otherwise("middle").alias("child_role"))


def _semantic(t: DataFrame) -> list[str]:
    skos = profile_name(t).first()["profile"] == "skos"
    return (R.SKOS_PREDICATES if skos else []) + R.SEMANTIC_PREDICATES


def schema_preview(t: DataFrame, subjects: int = 8, per_subject: int = 3) -> DataFrame:
    """(subject, predicate, object, score): the best-scored subjects and their best triples.

    A predicate scores by its place in the semantic list (the first scores the length of the list, the
    last 1), bookkeeping predicates 0 and anything else 1. The best triples of a subject are picked before
    those whose two short names agree are left out.
    """
    names = _semantic(t)
    short = R.short_name(F.col("p"))
    score = F.lit(1)
    for i, n in enumerate(names):
        score = F.when(short == n, F.lit(len(names) - i)).otherwise(score)
    score = F.when(F.col("p").isin(R.META_PREDICATES), F.lit(0)).otherwise(score)
    scored = t.withColumn("score", score.cast("long"))
    best = scored.groupBy("s").agg(F.sum("score").alias("total")).orderBy(F.desc("total"), "s").limit(subjects)
    # Spark limits each group on the map side for row_number <= k, so a huge subject sends few rows
    place = F.row_number().over(W.partitionBy("s").orderBy(F.desc("score"), "p", "o"))
    top = (scored.join(F.broadcast(best.select("s")), "s", "left_semi").withColumn("_i", place)
           .filter(F.col("_i") <= per_subject))
    return top.select(R.short_name(F.col("s")).alias("subject"), R.short_name(F.col("p")).alias("predicate"),
                      R.short_name(F.col("o"), F.col("o_type")).alias("object"), "score").filter("subject <> object")


def triple_preview(t: DataFrame, rows: int = 50, filter_meta: bool = True) -> DataFrame:
    """(subject, predicate, object) short names: semantic predicates first, then by predicate."""
    base = t.filter(~F.col("p").isin(R.META_PREDICATES)) if filter_meta else t
    named = base.select(R.short_name(F.col("s")).alias("subject"), R.short_name(F.col("p")).alias("predicate"),
                        R.short_name(F.col("o"), F.col("o_type")).alias("object"))
    sem = (~F.col("predicate").isin(_semantic(t))).cast("int")
    return named.orderBy(sem, "predicate", "subject", "object").limit(rows)


def remap_import(t: DataFrame, iri: str, loaded: DataFrame | None = None, new_iri: str | None = None) -> DataFrame:
    """Merge the loaded graph and drop the import triple, or point the import at another IRI."""
    is_import = (F.col("p") == R.IMPORTS) & (F.col("o") == iri)
    if loaded is not None:
        return union_graphs(t.filter(~is_import), loaded)
    return t.withColumn("o", F.when(is_import, F.lit(new_iri)).otherwise(F.col("o")))
