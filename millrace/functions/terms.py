"""RDF terms: short names and namespaces. Fixed vocabulary IRIs are at the top."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: W3C vocabulary
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE = RDF + "type"
PROPERTY = RDF + "Property"
SUBCLASS, SUBPROPERTY = RDFS + "subClassOf", RDFS + "subPropertyOf"
LABEL, COMMENT = RDFS + "label", RDFS + "comment"
DOMAIN, RANGE = RDFS + "domain", RDFS + "range"
CLASS, ONTOLOGY = OWL + "Class", OWL + "Ontology"
OBJECT_PROPERTY, DATATYPE_PROPERTY = OWL + "ObjectProperty", OWL + "DatatypeProperty"
ANNOTATION_PROPERTY, INDIVIDUAL = OWL + "AnnotationProperty", OWL + "NamedIndividual"
IMPORTS, EQUIVALENT_CLASS = OWL + "imports", OWL + "equivalentClass"

# fixed values: bookkeeping predicates left out of previews
META_PREDICATES = [TYPE, RDFS + "isDefinedBy", OWL + "versionInfo", IMPORTS, OWL + "versionIRI",
                   OWL + "ontologyIRI"]
# fixed values: predicates that carry meaning, most interesting first
SEMANTIC_PREDICATES = ["subClassOf", "subPropertyOf", "domain", "range", "equivalentClass",
                       "equivalentProperty", "disjointWith", "inverseOf", "onProperty"]
SKOS_PREDICATES = ["broader", "narrower", "related", "hasTopConcept", "topConceptOf", "member"]


def short_name(term: Column, kind: Column | None = None) -> Column:
    """After ``#``, else after the last ``/``; literals are cut at 40, blank nodes to ``_:`` + 8."""
    local = F.when(term.contains("#"), F.coalesce(F.nullif(F.substring_index(term, "#", -1), F.lit("")),
                                                  F.substring_index(term, "/", -1)))
    iri = local.otherwise(F.coalesce(F.nullif(F.substring_index(term, "/", -1), F.lit("")), term))
    blank = F.when(term.startswith("_:"), F.concat(F.lit("_:"), F.substring(term, 3, 8)))
    if kind is None:
        return blank.otherwise(iri)
    literal = F.when(F.length(term) > 40, F.concat(F.substring(term, 1, 40), F.lit("…"))).otherwise(term)
    return F.when(kind == "literal", literal).otherwise(blank.otherwise(iri))


def namespace(term: Column) -> Column:
    """Up to and including ``#``, else up to and including the last ``/``."""
    hashed = F.concat(F.substring_index(term, "#", 1), F.lit("#"))
    slashed = F.regexp_extract(term, r"^(.*/)", 1)
    return F.when(term.contains("#"), hashed).when(term.contains("/"), slashed).otherwise(term)
