"""Term tables out of a triple table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import iri_to_id
from termloom.operators import graph
from termloom.operators.terms import filter_namespace, filter_obsolete, filter_subset

# Public vocabulary terms and namespaces.
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
EXACT_SYNONYM = "http://www.geneontology.org/formats/oboInOwl#hasExactSynonym"
IN_SUBSET = "http://www.geneontology.org/formats/oboInOwl#inSubset"
ALT_LABEL = "http://www.w3.org/2004/02/skos/core#altLabel"
PREF_LABEL = "http://www.w3.org/2004/02/skos/core#prefLabel"
DEFINITION = "http://purl.obolibrary.org/obo/IAO_0000115"
EXTERNAL_DEFINITION = "http://purl.obolibrary.org/obo/UBPROP_0000010"
PART_OF = "http://purl.obolibrary.org/obo/BFO_0000050"
OBO = "http://purl.obolibrary.org/obo/"
UBERON = "http://purl.obolibrary.org/obo/UBERON_"
HGNC = "http://identifiers.org/hgnc/"
HUMAN_SUBSET = "http://purl.obolibrary.org/obo/uberon/core#human_subset"

MESH = "http://id.nlm.nih.gov/mesh/"
MESH_VOCABULARY = "http://id.nlm.nih.gov/mesh/vocab#"
CONCEPT = MESH_VOCABULARY + "Concept"
IDENTIFIER = MESH_VOCABULARY + "identifier"
TREE_NUMBER = MESH_VOCABULARY + "treeNumber"
PARENT_TREE_NUMBER = MESH_VOCABULARY + "parentTreeNumber"
PREFERRED_CONCEPT = MESH_VOCABULARY + "preferredConcept"
PREFERRED_TERM = MESH_VOCABULARY + "preferredTerm"
BROADER_DESCRIPTOR = MESH_VOCABULARY + "broaderDescriptor"
HEADING_LABEL = MESH_VOCABULARY + "prefLabel"
HEADING_ALT_LABEL = MESH_VOCABULARY + "altLabel"
SCOPE_NOTE = MESH_VOCABULARY + "scopeNote"

# Headings whose subtrees hold anatomy and cell types.
ANATOMY_ROOTS = [
    "D009141",  # musculoskeletal system
    "D004064",  # digestive system
    "D012137",  # respiratory system
    "D014566",  # urogenital system
    "D002319",  # cardiovascular system
    "D009420",  # nervous system
    "D006424",  # hemic and immune systems
    "D012867",  # skin
    "D005123",  # eye
    "D010920",  # placenta
    "D001940",  # breast
    "D000273",  # adipose tissue
    "D000311",  # adrenal glands
]


def describe(name: str, *candidates: str) -> Column:
    """First known description, else the name."""
    return F.coalesce(*candidates, name)


def extract_terms(
    triples: DataFrame,
    graphs: Sequence[str],
    *,
    namespace: str | None = None,
    id_rules: Mapping[str, str],
    synonyms: Sequence[str] = (EXACT_SYNONYM,),
    subset: str | None = None,
    subset_prefixes: Sequence[str] = (),
    drop_obsolete: bool = False,
    present_in: str | None = None,
    part_of: DataFrame | None = None,
) -> DataFrame:
    """Distinct term rows of the merged graphs.

    ``namespace`` keeps its IRIs; ``id_rules`` shorten IRIs to ids; ``subset`` with
    ``subset_prefixes`` keeps a named subset or the given id prefixes; ``present_in`` asks for a
    label in another graph; ``part_of`` is a seed table whose parts at any depth are kept.
    """
    # One graph holds a triple once; only several need to be merged.
    single = triples.filter(F.col("g") == graphs[0]).select("s", "p", "o")
    merged = single if len(graphs) == 1 else graph.merge_graphs(triples, graphs)
    terms = graph.match(merged, LABEL, "iri", "name")
    if namespace is not None:
        terms = filter_namespace(terms, namespace)
    if drop_obsolete:
        terms = filter_obsolete(terms)
    terms = terms.withColumn("id", iri_to_id(F.col("iri"), id_rules))
    if subset is not None:
        terms = graph.optional(terms, graph.match(merged, IN_SUBSET, "iri", "subset"))
        terms = filter_subset(terms, subset, subset_prefixes).drop("subset").distinct()
    if present_in is not None:
        terms = graph.exists_in_graph(terms, triples, present_in, LABEL)
    if part_of is not None:
        edges = graph.match(merged, PART_OF, "child", "parent")
        reached = graph.descendants(edges, part_of)
        terms = terms.join(reached.withColumnRenamed("node", "iri"), "iri", "left_semi")
    terms = graph.optional(terms, graph.joined_values(merged, synonyms, "iri"))
    terms = graph.optional(terms, graph.match(merged, DEFINITION, "iri", "d1"))
    terms = graph.optional(terms, graph.match(merged, EXTERNAL_DEFINITION, "iri", "d2"))
    return terms.select(
        "iri", "id", "name", "aka", describe("name", "d1", "d2").alias("description")
    ).distinct()


def tree_descendants(triples: DataFrame, roots: DataFrame) -> DataFrame:
    """``descriptor``: headings below the roots, along their tree numbers."""
    numbers = graph.match(triples, TREE_NUMBER, "descriptor", "node")
    root = F.col(roots.columns[0]).alias("descriptor")
    start = numbers.join(roots.select(root), "descriptor", "left_semi").select("node")
    edges = graph.match(triples, PARENT_TREE_NUMBER, "child", "parent")
    reached = graph.descendants(edges, start)
    return numbers.join(reached, "node", "left_semi").select("descriptor").distinct()


def broader_descendants(triples: DataFrame, seeds: DataFrame) -> DataFrame:
    """``term``: preferred concepts of the headings at or below the seeds' headings."""
    preferred = graph.match(triples, PREFERRED_CONCEPT, "descriptor", "term").distinct()
    seed = F.col(seeds.columns[0]).alias("term")
    start = preferred.join(seeds.select(seed), "term", "left_semi").select("descriptor")
    edges = graph.match(triples, BROADER_DESCRIPTOR, "child", "parent")
    reached = graph.descendants(edges, start).withColumnRenamed("node", "descriptor")
    return preferred.join(reached, "descriptor", "left_semi").select("term").distinct()


def _concept_terms(triples: DataFrame, concepts: DataFrame) -> DataFrame:
    """Add id, name, synonyms and description to a frame with a ``term`` column."""
    is_concept = triples.filter((F.col("p") == TYPE) & (F.col("o") == CONCEPT)).select(
        F.col("s").alias("term")
    )
    rows = graph.bgp(
        concepts.join(is_concept, "term", "left_semi"),
        graph.match(triples, IDENTIFIER, "term", "id"),
        graph.match(triples, PREFERRED_TERM, "term", "label_node"),
        graph.match(triples, HEADING_LABEL, "label_node", "name"),
    )
    rows = graph.optional(rows, graph.joined_values(triples, HEADING_ALT_LABEL, "label_node"))
    rows = graph.optional(rows, graph.match(triples, SCOPE_NOTE, "term", "note"))
    return rows.withColumn("description", describe("name", "note"))


def extract_headings(
    triples: DataFrame, roots: DataFrame | None = None, with_descriptor: bool = False
) -> DataFrame:
    """Term rows of all headings below the roots; one per descriptor if asked for.

    Without roots those of anatomy and cell types are taken.
    """
    if roots is None:
        names = [(MESH + root,) for root in ANATOMY_ROOTS]
        roots = triples.sparkSession.createDataFrame(names, "iri string")
    headings = tree_descendants(triples, roots)
    lead: list[str] = []
    if with_descriptor:
        lead = ["descriptor", "descriptor_id"]
        headings = graph.bgp(headings, graph.match(triples, IDENTIFIER, *lead))
    concepts = graph.bgp(headings, graph.match(triples, PREFERRED_CONCEPT, "descriptor", "term"))
    concepts = concepts.select(*lead, "term").distinct()
    return _concept_terms(triples, concepts).select(
        *lead, F.col("term").alias("iri"), "id", "name", "aka", "description"
    ).distinct()


def extract_concepts(triples: DataFrame, seeds: DataFrame) -> DataFrame:
    """Term rows of the concepts at or below the seed concepts."""
    concepts = broader_descendants(triples, seeds)
    return _concept_terms(triples, concepts).select(
        F.col("term").alias("iri"), "id", "name", "aka", "description"
    ).distinct()
