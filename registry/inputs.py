"""Reference-shaped inputs derived from the given tables.

``SHARED`` holds plain SQL that Spark and DuckDB both run. ``CHECK_ONLY`` restates operator
results in SQL for the checks. ``{name}`` stands for a given table or another definition.
"""

from __future__ import annotations

# Mapping models: name, slice of the vector, minimum score (strict).
MODELS = [
    ("human descriptions", 1, 64, 0.3),
    ("first half", 1, 32, 0.4),
    ("second half", 33, 64, 0.45),
    ("front", 1, 48, 0.35),
    ("back", 17, 64, 0.36),
]

RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
OIO = "http://www.geneontology.org/formats/oboInOwl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
OBO = "http://purl.obolibrary.org/obo/"
MESH = "http://id.nlm.nih.gov/mesh/"
MESHV = "http://id.nlm.nih.gov/mesh/vocab#"
HUMAN = "http://purl.obolibrary.org/obo/uberon/core#human_subset"
ANATOMY, CELLS, GENES = "urn:graph:anatomy", "urn:graph:cells", "urn:graph:genes"
COLLECTION, REDUNDANT = "urn:graph:collection", "urn:graph:collection-redundant"
HEADINGS = "urn:graph:headings"

SHARED: dict[str, str] = {}
CHECK_ONLY: dict[str, str] = {}
KEEP = {"proposed", "scores", "mappings", "truth", "prepared", "triples", "heading_nodes", "evaluated"}

SHARED["terms"] = """
SELECT 'http://example.org/doc/' || doc_id AS iri, 'DOC_' || doc_id AS id,
  CASE WHEN doc_id % 7 = 3 THEN 'obsolete ' ELSE '' END || lang || '  document' || chr(160)
    || doc_id AS name,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang || '; ' || source END AS aka,
  text AS description
FROM {documents}"""

SHARED["passages"] = """
SELECT 'http://example.org/item/' || item_id AS iri, 'ITEM_' || item_id AS id,
  'passage ' || item_id AS name, '' AS aka, text AS description
FROM {benchmark}"""

for side, letter in (("left", "V"), ("right", "W")):
    SHARED[f"{side}_vectors"] = f"SELECT '{letter}_' || vec_id AS id, embedding FROM {{embeddings}}"
SHARED["left_terms"] = """
SELECT 'http://example.org/left/' || vec_id AS iri, 'V_' || vec_id AS id,
  'left concept ' || vec_id AS name,
  CASE WHEN label % 2 = 0 THEN '' ELSE 'class ' || label END AS aka,
  'concept of label ' || label AS description, vec_id, label
FROM {embeddings}"""
SHARED["right_terms"] = """
SELECT CASE WHEN label < 5 THEN 'http://example.org/right/AS_'
    ELSE 'http://example.org/right/CT_' END || vec_id AS iri,
  'W_' || vec_id AS id, 'right concept ' || vec_id AS name, '' AS aka,
  'target of label ' || label AS description, vec_id, label
FROM {embeddings}"""

# Ground truth: the pairs that any model proposed are judged by equal labels.
# Two classes cannot be mapped.
SHARED["subjects"] = """
SELECT iri AS subject_id, name AS subject_label, label, label IN (4, 9) AS unmappable,
  CASE WHEN label < 5 THEN 'Anatomical structure' ELSE 'Cell type' END AS mesh_concept_group,
  CASE WHEN label IN (4, 9) THEN 'reason ' || (vec_id % 3) END AS exclusion_reason
FROM {left_terms}"""
SHARED["proposed"] = """
SELECT DISTINCT m.subject_id, m.object_id, CASE WHEN s.label = r.label THEN 1 ELSE 0 END AS accurate
FROM {mappings} m JOIN {subjects} s ON m.subject_id = s.subject_id AND NOT s.unmappable
JOIN {right_terms} r ON m.object_id = r.iri"""
SHARED["truth"] = """
SELECT s.subject_id || '|' || j.object_id AS pair_id, s.subject_id, s.subject_label,
  s.mesh_concept_group,
  CASE WHEN s.unmappable THEN 0 ELSE CAST(greatest(coalesce(k.n, 0), 1) AS INT) END AS mapping_count,
  CASE WHEN s.unmappable THEN 'Unmappable' ELSE 'Mappable' END AS mappability,
  s.exclusion_reason, coalesce(j.accurate, 0) AS accurate_mapping
FROM {subjects} s
LEFT JOIN {proposed} j ON s.subject_id = j.subject_id
LEFT JOIN (SELECT subject_id, count(*) AS n FROM {proposed} WHERE accurate = 1 GROUP BY subject_id) k
  ON s.subject_id = k.subject_id"""

# Triples: parts as anatomy with a part-of tree, suppliers as cells, nations as genes,
# regions, nations and customers as headings.
_UBERON = f"'{OBO}UBERON_' || p_partkey"


def _part(predicate: str, value: str, graph: str, where: str = "") -> str:
    return (
        f"SELECT {_UBERON} AS s, '{predicate}' AS p, {value} AS o, '{graph}' AS g "
        f"FROM {{part}} {where}"
    )


_NAME = "CASE WHEN p_size = 1 THEN 'obsolete ' ELSE '' END || p_name || ' ' || p_partkey"
_PARENT = f"'{OBO}UBERON_' || CAST(floor(p_partkey / 4) AS BIGINT)"
_SYNONYM, _SUBSET = OIO + "hasExactSynonym", OIO + "inSubset"
_DEFINITION, _EXTERNAL, _PART_OF = OBO + "IAO_0000115", OBO + "UBPROP_0000010", OBO + "BFO_0000050"

_triples = [
    _part(RDFS_LABEL, _NAME, ANATOMY),
    _part(_SYNONYM, "p_brand", ANATOMY, "WHERE p_size <> 7"),
    _part(_SYNONYM, "p_type", ANATOMY, "WHERE p_size <> 7"),
    _part(_DEFINITION, "'definition of ' || p_name", ANATOMY, "WHERE p_size > 20"),
    _part(_EXTERNAL, "'note on ' || p_type", ANATOMY, "WHERE p_size > 10"),
    _part(_SUBSET, f"'{HUMAN}'", ANATOMY, "WHERE p_size < 40"),
    _part(_SUBSET, "'urn:subset:other'", ANATOMY, "WHERE p_size > 30"),
    _part(RDFS_LABEL, _NAME, COLLECTION, "WHERE p_size >= 10"),
    _part(_SYNONYM, "p_brand", COLLECTION, "WHERE p_size >= 15"),
    _part(_DEFINITION, "'definition of ' || p_name", COLLECTION, "WHERE p_size >= 10"),
    _part(_PART_OF, _PARENT, COLLECTION, "WHERE p_size >= 5"),
    _part(_PART_OF, _PARENT, REDUNDANT),
]
for predicate, value in [
    (RDFS_LABEL, "s_name"),
    (_SYNONYM, "'vendor ' || s_suppkey"),
    (SKOS + "altLabel", "'seller ' || s_suppkey"),
]:
    _triples.append(
        f"SELECT '{OBO}CL_' || s_suppkey AS s, '{predicate}' AS p, {value} AS o, '{CELLS}' AS g "
        "FROM {supplier}"
    )
for predicate, value in [(RDFS_LABEL, "n_name"), (SKOS + "prefLabel", "'gene ' || n_name")]:
    _triples.append(
        f"SELECT 'http://identifiers.org/hgnc/' || n_nationkey AS s, '{predicate}' AS p, "
        f"{value} AS o, '{GENES}' AS g FROM {{nation}}"
    )

SHARED["heading_nodes"] = """
SELECT 'R' || r_regionkey AS kid, CAST(NULL AS STRING) AS parent, r_name AS label,
  'area ' || r_regionkey AS alt, CAST(NULL AS STRING) AS note FROM {region}
UNION ALL
SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name, 'state ' || n_nationkey,
  CASE WHEN n_nationkey % 2 = 0 THEN 'nation of region ' || n_regionkey END FROM {nation}
UNION ALL
SELECT 'C' || c_custkey, 'N' || c_nationkey, c_name, c_mktsegment,
  CASE WHEN c_acctbal > 5000 THEN 'large buyer in ' || c_mktsegment END FROM {customer}"""


def _heading(subject: str, predicate: str, value: str, where: str = "") -> str:
    return (
        f"SELECT '{MESH}{subject}' || kid AS s, '{predicate}' AS p, {value} AS o, "
        f"'{HEADINGS}' AS g FROM {{heading_nodes}} {where}"
    )


_triples += [
    _heading("D", RDF_TYPE, f"'{MESHV}TopicalDescriptor'"),
    _heading("D", MESHV + "identifier", "'D' || kid"),
    _heading("D", MESHV + "treeNumber", f"'{MESH}T' || kid"),
    _heading("T", MESHV + "parentTreeNumber", f"'{MESH}T' || parent", "WHERE parent IS NOT NULL"),
    _heading("D", MESHV + "broaderDescriptor", f"'{MESH}D' || parent", "WHERE parent IS NOT NULL"),
    _heading("D", MESHV + "preferredConcept", f"'{MESH}M' || kid"),
    _heading("M", RDF_TYPE, f"'{MESHV}Concept'"),
    _heading("M", MESHV + "identifier", "'M' || kid"),
    _heading("M", MESHV + "preferredTerm", f"'{MESH}E' || kid"),
    _heading("M", MESHV + "scopeNote", "note", "WHERE note IS NOT NULL"),
    _heading("E", MESHV + "prefLabel", "label"),
    _heading("E", MESHV + "altLabel", "alt"),
    _heading("E", MESHV + "altLabel", "'also ' || alt"),
]
SHARED["triples"] = "\nUNION ALL\n".join(_triples)

SHARED["part_seeds"] = f"SELECT '{OBO}UBERON_' || (r_regionkey + 1) AS iri FROM {{region}}"
SHARED["heading_roots"] = f"SELECT '{MESH}DN' || n_nationkey AS iri FROM {{nation}}"
SHARED["concept_seeds"] = f"SELECT '{MESH}MN' || n_nationkey AS iri FROM {{nation}}"

# Property graph: a part and the suppliers that ship it share a concept.
SHARED["codes"] = """
SELECT 'PART:' || p_partkey AS code_id, 'PART' AS sab FROM {part}
UNION ALL SELECT 'MSH:S' || s_suppkey, 'MSH' FROM {supplier}"""
SHARED["concept_code"] = """
SELECT 'C' || p_partkey AS concept, 'PART:' || p_partkey AS code_id FROM {part}
UNION ALL SELECT 'C' || l_partkey, 'MSH:S' || l_suppkey FROM {lineitem}"""
SHARED["code_term"] = """
SELECT 'PART:' || p_partkey AS code_id, p_name AS name FROM {part}
UNION ALL SELECT 'PART:' || p_partkey, upper(p_name) FROM {part}
UNION ALL SELECT 'PART:' || p_partkey, p_brand FROM {part}
UNION ALL SELECT 'MSH:S' || s_suppkey, s_name FROM {supplier}
UNION ALL SELECT 'MSH:S' || s_suppkey, 'vendor ' || s_suppkey FROM {supplier}"""
SHARED["crosswalk"] = """
SELECT DISTINCT 'PART_' || l_partkey AS left_id, 'S' || l_suppkey AS right_id FROM {lineitem}"""
SHARED["part_terms"] = """
SELECT 'http://example.org/part/' || p_partkey AS iri, 'PART_' || p_partkey AS id,
  p_name AS name, p_brand AS aka, p_type AS description FROM {part}"""
SHARED["supplier_descriptors"] = """
SELECT 'http://example.org/d/' || s_suppkey AS descriptor, 'S' || s_suppkey AS descriptor_id,
  'http://example.org/supplier/' || s_suppkey AS iri, 'M' || s_suppkey AS id, s_name AS name,
  '' AS aka, s_name AS description FROM {supplier}
UNION ALL
SELECT 'http://example.org/d/' || s_suppkey, 'S' || s_suppkey,
  'http://example.org/supplier/n' || s_suppkey, 'MN' || s_suppkey, 'narrow ' || s_name, '', s_name
FROM {supplier} WHERE s_acctbal < 0"""

# Files and replies as text.
SHARED["search_replies"] = """
SELECT 'PART_' || p_partkey AS source,
  CASE WHEN p_size % 9 = 0 THEN 'Error: no answer' || chr(10) ELSE '' END
  || '{{"id": "S_' || p_size || '", "score": 0.' || (p_size + 10) || ', "content": null}}' || chr(10)
  || '{{"id": "S_half", "score": 0.5}}' || chr(10)
  || CASE WHEN p_size % 4 = 0 THEN '{{"id": "S_broken", "score"' || chr(10) ELSE '' END
  || '{{"id": "S_top", "score": 0.9' || (p_size % 10) || '}}' AS reply
FROM {part}"""
SHARED["ranked_lines"] = """
SELECT CASE WHEN p_size < 5 THEN 'PART_' || p_partkey || ',T_' || p_size || ',0.8' || p_size || ',1,'
  ELSE 'PART_' || p_partkey || ',T_' || p_size || ',' || (p_size % 3 + 1) || ',0.' || (p_size + 10)
  END AS line FROM {part}"""

# SQL statements of operator results, for the checks only ---------------------------------------

CHECK_ONLY["scores"] = """
SELECT source, target, score FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS rn FROM (
    SELECT a.id AS source, b.id AS target,
      round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score
    FROM {left_vectors} a, {right_vectors} b))
WHERE rn <= 10"""


def _model_sql(model: str, low: int, high: int, minimum: float) -> str:
    return f"""
SELECT l.iri AS subject_id, l.name AS subject_label, 'skos:relatedMatch' AS predicate_id,
  r.iri AS object_id, r.name AS object_label, score AS similarity_score, '' AS comment,
  'semapv:SemanticSimilarityThresholdMatching' AS mapping_justification, '{model}' AS model
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS rn FROM (
  SELECT 'V_' || a.vec_id AS source, 'W_' || b.vec_id AS target,
    round(list_cosine_similarity(a.embedding[{low}:{high}]::DOUBLE[],
      b.embedding[{low}:{high}]::DOUBLE[]), 9) AS score
  FROM {{embeddings}} a, {{embeddings}} b WHERE a.vec_id <> b.vec_id)
  WHERE score > {minimum})
JOIN {{left_terms}} l ON source = l.id JOIN {{right_terms}} r ON target = r.id WHERE rn <= 10"""


CHECK_ONLY["mappings"] = "\nUNION ALL\n".join(_model_sql(*m) for m in MODELS)
CHECK_ONLY["mappable"] = "SELECT * FROM {truth} WHERE mappability = 'Mappable'"
CHECK_ONLY["concepts"] = """
SELECT DISTINCT subject_id, subject_label, mesh_concept_group, mapping_count FROM {mappable}"""
CHECK_ONLY["judged"] = """
SELECT m.*, m.subject_id || '|' || m.object_id AS pair_id,
  coalesce(t.accurate_mapping, 0) AS accurate_mapping,
  row_number() OVER (PARTITION BY m.model, m.subject_id ORDER BY m.similarity_score DESC, m.object_id)
    AS concept_pair_rank
FROM {mappings} m LEFT JOIN (SELECT * FROM {truth} WHERE pair_id IS NOT NULL) t
  ON t.pair_id = m.subject_id || '|' || m.object_id
WHERE m.subject_label IN (SELECT subject_label FROM {mappable})"""
CHECK_ONLY["prepared"] = """
SELECT c.model, j.mapping_justification, c.subject_id, j.predicate_id, j.object_id, j.pair_id,
  c.subject_label, j.object_label, c.mesh_concept_group, j.similarity_score,
  coalesce(j.accurate_mapping, 0) AS accurate_mapping, j.concept_pair_rank, c.mapping_count,
  CASE WHEN j.accurate_mapping = 1 THEN j.running::BIGINT ELSE 0 END AS mapping_result_number,
  CASE WHEN c.accurate = 1 THEN 'Hit' ELSE 'Miss' END AS hit_miss_concept,
  CASE WHEN j.accurate_mapping = 1 THEN 'Hit' ELSE 'Miss' END AS hit_miss_mapping,
  c.accurate IS NOT NULL AS model_analyzed
FROM (SELECT m.model, k.*, a.accurate
  FROM {concepts} k CROSS JOIN (SELECT DISTINCT model FROM {judged}) m
  LEFT JOIN (SELECT model, subject_id, subject_label, max(accurate_mapping) AS accurate
    FROM {judged} GROUP BY ALL) a
  ON a.model = m.model AND a.subject_id = k.subject_id AND a.subject_label = k.subject_label) c
LEFT JOIN (SELECT *, sum(accurate_mapping) OVER (
    PARTITION BY model, subject_id ORDER BY concept_pair_rank) AS running FROM {judged}) j
ON j.model = c.model AND j.subject_id = c.subject_id AND j.subject_label = c.subject_label"""
CHECK_ONLY["analyzed"] = """
SELECT * REPLACE (lower(hit_miss_mapping) AS hit_miss_mapping) FROM {prepared} WHERE model_analyzed"""

CHECK_ONLY["ballots"] = """
SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY model, subject_id ORDER BY similarity_score DESC, object_id) AS rn FROM {mappings})
WHERE rn = 1"""
CHECK_ONLY["vote_table"] = """
SELECT v.*, p.participants, o.opts, votes::DOUBLE / p.participants AS share,
  CASE WHEN h.object_id IS NULL THEN 0 ELSE 1 END AS human_desc_vec_sim
FROM (SELECT subject_id, object_id, subject_label, object_label, predicate_id,
    avg(similarity_score) AS mean_similarity, count(*) AS votes FROM {ballots} GROUP BY ALL) v
JOIN (SELECT subject_id, count(DISTINCT model) AS participants FROM {ballots} GROUP BY 1) p
  ON p.subject_id = v.subject_id
JOIN (SELECT subject_id, count(DISTINCT object_id) AS opts FROM {ballots} GROUP BY 1) o
  ON o.subject_id = v.subject_id
LEFT JOIN (SELECT subject_id, object_id FROM {ballots} WHERE model = 'human descriptions') h
  ON h.subject_id = v.subject_id AND h.object_id = v.object_id"""
CHECK_ONLY["tie_patterns"] = """
SELECT DISTINCT participants, opts, most,
  CASE WHEN participants = opts OR (participants = 5 AND opts = 3 AND most = 2)
    OR (participants = 4 AND opts = 2 AND most = 2) THEN 1 ELSE 0 END AS ties
FROM (SELECT subject_id, max(participants) AS participants, max(opts) AS opts, max(votes) AS most
  FROM {vote_table} GROUP BY 1)"""
CHECK_ONLY["pooled"] = """
SELECT v.*, coalesce(t.ties, 0) AS ties FROM {vote_table} v LEFT JOIN {tie_patterns} t
ON t.participants = v.participants AND t.opts = v.opts AND t.most = v.votes"""
CHECK_ONLY["evaluated"] = """
SELECT e.*, CASE WHEN accurate_mapping = 1 THEN (sum(accurate_mapping) OVER (
    PARTITION BY subject_id ORDER BY concept_pair_rank))::BIGINT ELSE 0 END AS mapping_result_number,
  CASE WHEN accurate_mapping = 1 THEN 'Hit' ELSE 'Miss' END AS hit_miss_mapping,
  CASE WHEN max(accurate_mapping) OVER (PARTITION BY subject_id) = 1 THEN 'Hit' ELSE 'Miss' END
    AS hit_miss_concept,
  CASE WHEN accurate_mapping = 1 AND concept_pair_rank = 1 AND ties = 0 THEN 1 END
    AS top_vote_correct,
  'semapv:SemanticSimilarity' AS mapping_justification, 'pooled-K1-vec-vote' AS model
FROM (SELECT p.*, p.subject_id || '|' || p.object_id AS pair_id,
    CASE WHEN u.subject_id IS NULL THEN 'Mappable' ELSE 'Unmappable' END AS mappability,
    CASE WHEN u.subject_id IS NULL THEN coalesce(t.accurate_mapping, 0) ELSE 0 END
      AS accurate_mapping,
    row_number() OVER (PARTITION BY p.subject_id
      ORDER BY votes DESC, mean_similarity DESC, p.object_id) AS concept_pair_rank,
    s.mesh_concept_group, s.mapping_count, s.subject_id IS NOT NULL AS model_analyzed
  FROM {pooled} p
  LEFT JOIN (SELECT DISTINCT subject_id FROM {truth} WHERE mappability = 'Unmappable') u
    ON u.subject_id = p.subject_id
  LEFT JOIN {mappable} t ON t.pair_id = p.subject_id || '|' || p.object_id
  LEFT JOIN (SELECT DISTINCT subject_id, mesh_concept_group, mapping_count FROM {truth}) s
    ON s.subject_id = p.subject_id) e"""

CHECK_ONLY["normed"] = """
SELECT * REPLACE ((similarity_score - avg(similarity_score) OVER ())
  / stddev_samp(similarity_score) OVER () AS similarity_score) FROM {analyzed}"""

# Prepared rows of the single models and of the pooled one.
CHECK_ONLY["all_prepared"] = """
SELECT * FROM {prepared} UNION ALL BY NAME SELECT model, mapping_justification, subject_id, predicate_id,
  object_id, pair_id, subject_label, object_label, mesh_concept_group,
  mean_similarity AS similarity_score, accurate_mapping, concept_pair_rank, mapping_count,
  mapping_result_number, hit_miss_concept, hit_miss_mapping, model_analyzed
FROM {evaluated} WHERE mappability = 'Mappable'"""

# Closures; DuckDB's recursive UNION removes duplicates and so ends on cycles.
CHECK_ONLY["part_closure"] = f"""
SELECT iri AS node FROM {{part_seeds}}
UNION SELECT t.s FROM part_closure c JOIN {{triples}} t ON t.o = c.node
  AND t.p = '{_PART_OF}' AND t.g IN ('{COLLECTION}', '{REDUNDANT}')"""
CHECK_ONLY["tree_closure"] = f"""
SELECT o AS node FROM {{triples}} WHERE p = '{MESHV}treeNumber'
  AND s IN (SELECT iri FROM {{heading_roots}})
UNION SELECT t.s FROM tree_closure c JOIN {{triples}} t ON t.o = c.node
  AND t.p = '{MESHV}parentTreeNumber'"""
CHECK_ONLY["broader_closure"] = f"""
SELECT s AS node FROM {{triples}} WHERE p = '{MESHV}preferredConcept'
  AND o IN (SELECT iri FROM {{concept_seeds}})
UNION SELECT t.s FROM broader_closure c JOIN {{triples}} t ON t.o = c.node
  AND t.p = '{MESHV}broaderDescriptor'"""
