"""Similarity, ranking, mapping sets and graph operators."""

from pyspark.sql import functions as F

from registry.core import placed, query
from registry.inputs import (
    ANATOMY, CELLS, COLLECTION, GENES, HUMAN, MESHV, MODELS, OBO, OIO, RDF_TYPE, RDFS_LABEL,
    REDUNDANT, SKOS,
)
from termloom.functions.ordering import top_by
from termloom.operators import extraction, graph, mappings, plugins, reranking
from termloom.operators.similarity import topk_similar

PART_OF = f"{OBO}BFO_0000050"

# Similarity ------------------------------------------------------------------------------------


@query("topk_similar", "SELECT * FROM {scores}")
def topk(t):
    return t.scores()


@query("topk_blocked", "SELECT * FROM {scores}")
def topk_blocked(t):
    return topk_similar(t.vectors("left"), t.vectors("right"), lanes=(3, 4))


@query("topk_similar_threshold", "SELECT * FROM {scores} WHERE score > 0.35")
def topk_threshold(t):
    return topk_similar(t.vectors("left"), t.vectors("right"), min_score=0.35)


@query(
    "topk_per_group",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (
      PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn
      FROM {lineitem}) WHERE rn <= 10""",
)
def topk_per_group(t):
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return top_by(t.base("lineitem"), ["l_suppkey"], order, 10).select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"
    )


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(texts):
    """Stands in for an embedding model: how often each letter occurs."""
    return [[float(text.count(letter)) for letter in LETTERS] for text in texts]


def letters_sql(content):
    counts = [f"length({content}) - length(replace({content}, '{c}', ''))" for c in LETTERS]
    return f"[{', '.join(counts)}]"


def _described(t):
    return t.derived("terms").select("id", F.col("description").alias("content"))


@query(
    "embed_content",
    f"""SELECT id, unnest(range(26)) AS place, unnest({letters_sql("description")})::DOUBLE AS value
    FROM {{terms}}""",
)
def embed_content(t):
    vectors = plugins.embed_content(_described(t), letter_counts)
    return vectors.select("id", F.posexplode("embedding").alias("place", "value")).select(
        "id", F.col("place").cast("long").alias("place"), F.col("value").cast("double").alias("value")
    )


@query("embed_content_hashed")
def embed_content_hashed(t):
    return plugins.embed_content(_described(t))


# Ranking ---------------------------------------------------------------------------------------

_CANDIDATES = """SELECT source, target, score, place,
  '[' || target || '] ' || r.description || chr(10) AS passage FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS place FROM {scores}) s
  JOIN {right_terms} r ON r.id = s.target WHERE place <= 3"""


def _content(t, side):
    return t.derived(f"{side}_terms").select("id", F.col("description").alias("content"))


def _candidates(t):
    return reranking.assemble_candidates(t.scores(), _content(t, "right"))


@query(
    "assemble_candidates",
    f"""SELECT source, string_agg(passage, chr(10) ORDER BY place) AS passages,
    string_agg(target, ',' ORDER BY place) AS targets FROM ({_CANDIDATES}) GROUP BY source""",
)
def assemble(t):
    targets = F.array_join(F.transform("candidates", lambda c: c["target"]), ",")
    return _candidates(t).select("source", "passages", targets.alias("targets"))


_RANK = "Concept $name ($aka): $content\n$input"


def _prompts(t):
    sources = t.derived("left_terms").withColumn("content", F.col("description"))
    return reranking.render_rank_prompt(_candidates(t), sources, _RANK)


@query(
    "render_rank_prompt",
    f"""SELECT c.source, 'Concept ' || l.name || ' (' || l.aka || '): ' || l.description || chr(10)
      || string_agg(passage, chr(10) ORDER BY place) AS prompt
    FROM ({_CANDIDATES}) c JOIN {{left_terms}} l ON l.id = c.source
    GROUP BY c.source, l.name, l.aka, l.description""",
)
def render_rank_prompt(t):
    return _prompts(t).select("source", "prompt")


def _reversing_model(prompts):
    """Stands in for a model: answers with the ids of the prompt, last one first."""
    replies = []
    for prompt in prompts:
        ids = [line[1 : line.index("]")] for line in prompt.split("\n") if line.startswith("[")]
        replies.append(" > ".join(f"[{i}]" for i in reversed(ids)))
    return replies


@query(
    "rank_with_model",
    f"""SELECT source, string_agg('[' || target || ']', ' > ' ORDER BY place DESC) AS reply
    FROM ({_CANDIDATES}) GROUP BY source""",
)
def rank_with_model(t):
    return reranking.rank_with_model(_prompts(t), _reversing_model).select("source", "reply")


def _shaped_replies(t):
    """Replies with all ids, with the middle one missing, or empty, by the length of the id."""
    ids = F.transform("candidates", lambda c: c["target"])
    some = F.concat_ws(", ", F.get(ids, F.lit(2)), F.get(ids, F.lit(0)))
    kind = F.substring("source", 3, 20).cast("int") % 3
    every = F.concat_ws(" then ", F.reverse(ids))
    reply = F.when(kind == 0, every).when(kind == 1, some).otherwise("  ")
    return _candidates(t).withColumn("reply", reply)


@query(
    "rank_from_reply",
    f"""SELECT source, target, score, row_number() OVER (PARTITION BY source ORDER BY
      CASE WHEN position(target IN reply) = 0 THEN length(reply) + 1 ELSE position(target IN reply) END,
      place) AS rank
    FROM (SELECT c.*, trim(CASE substr(c.source, 3)::INT % 3 WHEN 0 THEN r.back WHEN 1 THEN r.some
        ELSE '' END) AS reply FROM ({_CANDIDATES}) c
      JOIN (SELECT source, string_agg(target, ' then ' ORDER BY place DESC) AS back,
        string_agg(target, ', ' ORDER BY place DESC) FILTER (WHERE place <> 2) AS some
        FROM ({_CANDIDATES}) GROUP BY source) r ON r.source = c.source)""",
)
def rank_from_reply(t):
    return reranking.rank_from_reply(_shaped_replies(t))


def _ordering_model(prompts):
    """Stands in for a model: answers with the ids of the prompt, short ones first."""
    replies = []
    for prompt in prompts:
        ids = [line[1 : line.index("]")] for line in prompt.split("\n") if line.startswith("[")]
        replies.append(" > ".join(f"[{i}]" for i in sorted(ids, key=lambda i: (len(i), i))))
    return replies


@query(
    "rank_all_candidates",
    """SELECT source, target, score, row_number() OVER (PARTITION BY source ORDER BY length(target), target) AS rank
    FROM {scores}""",
)
def rank_all_candidates(t):
    """All ten candidates of a source, three at a time."""
    windows = reranking.assemble_windows(t.scores(), _content(t, "right"))
    sources = t.derived("left_terms").withColumn("content", F.col("description"))
    prompts = reranking.render_rank_prompt(windows, sources, _RANK)
    return reranking.rank_from_windows(reranking.rank_with_model(prompts, _ordering_model))


# Mapping sets ----------------------------------------------------------------------------------

_SCORED = """SELECT l.iri AS subject_id, l.name AS subject_label, 'skos:relatedMatch' AS predicate_id,
  r.iri AS object_id, r.name AS object_label, score AS similarity_score, '' AS comment,
  'semapv:SemanticSimilarityThresholdMatching' AS mapping_justification
  FROM {scores} JOIN {left_terms} l ON source = l.id JOIN {right_terms} r ON target = r.id"""


def _scored(t):
    return mappings.sssom_scored(t.derived("left_terms"), t.derived("right_terms"), t.scores())


@query("sssom_scored", _SCORED)
def sssom_scored(t):
    return _scored(t)


@query(
    "order_mappings",
    f"""SELECT *, row_number() OVER (ORDER BY subject_id, similarity_score DESC, object_id) AS position
    FROM ({_SCORED})""",
)
def order_mappings(t):
    return placed(mappings.order_mappings(_scored(t)))


@query(
    "sssom_ranked",
    """SELECT l.iri AS subject_id, l.name AS subject_label, 'skos:relatedMatch' AS predicate_id,
    r.iri AS object_id, r.name AS object_label, round_even(rank, 0)::INT AS score, '' AS comment,
    'semapv:SemanticSimilarityThresholdMatching' AS mapping_justification
    FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS rank
      FROM {scores}) JOIN {left_terms} l ON source = l.id JOIN {right_terms} r ON target = r.id
    WHERE rank <= 3""",
)
def sssom_ranked(t):
    kept = _candidates(t).withColumn("reply", F.lit(""))
    return mappings.sssom_ranked(
        t.derived("left_terms"), t.derived("right_terms"), reranking.rank_from_reply(kept)
    )


_LOGICAL = """SELECT l.iri AS subject_id, l.name AS subject_label, 'skos:exactMatch' AS predicate_id,
  r.iri AS object_id, r.name AS object_label, '' AS comment,
  'semapv:LogicalReasoning' AS mapping_justification
  FROM {crosswalk} c JOIN {part_terms} l ON l.id = c.left_id
  JOIN {supplier_descriptors} r ON r.descriptor_id = c.right_id"""


@query("sssom_logical", _LOGICAL)
def sssom_logical(t):
    return mappings.sssom_logical(
        t.derived("part_terms"), t.derived("supplier_descriptors"), t.derived("crosswalk")
    )


_LABELS = """(SELECT code_id, string_agg(label, '; ' ORDER BY first) AS labels FROM (
  SELECT code_id, lower(name) AS label, min(name) AS first FROM {code_term} GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "shared_concept_crosswalk",
    f"""SELECT DISTINCT replace(a.code_id, ':', '_') AS left_id, replace(b.code_id, 'MSH:', '') AS right_id,
      x.labels AS left_labels, y.labels AS right_labels
    FROM {{concept_code}} a JOIN {{codes}} ca ON ca.code_id = a.code_id AND ca.sab = 'PART'
    JOIN {{concept_code}} b ON b.concept = a.concept
    JOIN {{codes}} cb ON cb.code_id = b.code_id AND cb.sab = 'MSH'
    JOIN {_LABELS} x ON x.code_id = a.code_id JOIN {_LABELS} y ON y.code_id = b.code_id""",
)
def shared_concept_crosswalk(t):
    return mappings.crosswalk(
        t.derived("codes"), t.derived("concept_code"), t.derived("code_term"),
        "PART", "MSH", right_drop="MSH:",
    )


_SPOILED = """(SELECT CASE WHEN object_id LIKE '%7' THEN 'no identifier' ELSE subject_id END AS subject_id,
  CASE WHEN object_id LIKE '%8' THEN 'skos:sameMatch' ELSE predicate_id END AS predicate_id,
  object_id,
  CASE WHEN object_id LIKE '%9' THEN similarity_score + 1 ELSE similarity_score END AS similarity_score,
  CASE WHEN object_id LIKE '%5' THEN '' ELSE mapping_justification END AS mapping_justification
  FROM {mappings})"""


@query(
    "validate_mappings",
    f"""WITH m AS {_SPOILED}
    SELECT 'subject_id is no IRI or CURIE' AS rule, subject_id, predicate_id, object_id FROM m
      WHERE subject_id = 'no identifier'
    UNION ALL SELECT 'predicate_id is unknown', subject_id, predicate_id, object_id FROM m
      WHERE predicate_id = 'skos:sameMatch'
    UNION ALL SELECT 'similarity_score is outside 0 to 1', subject_id, predicate_id, object_id FROM m
      WHERE similarity_score > 1
    UNION ALL SELECT 'mapping_justification is empty', subject_id, predicate_id, object_id FROM m
      WHERE mapping_justification = ''
    UNION ALL SELECT 'mapping is repeated', subject_id, predicate_id, object_id FROM m
      GROUP BY ALL HAVING count(*) > 1""",
)
def validate_mappings(t):
    return mappings.validate_mappings(t.sql(f"SELECT * FROM {_SPOILED}"))


@query("append_models", "SELECT * FROM {mappings}")
def append_models(t):
    rows = t.mappings
    return mappings.append_sets(
        {name: rows.filter(F.col("model") == name).drop("model") for name, *_ in MODELS}
    )


@query(
    "distinct_rows",
    "SELECT DISTINCT subject_id, subject_label FROM {mappings}",
)
def distinct_rows(t):
    return t.mappings.select("subject_id", "subject_label").distinct()


# Graph patterns --------------------------------------------------------------------------------


@query(
    "bgp_match",
    f"""SELECT a.s AS term, b.o AS id, c.o AS label_node, d.o AS name
    FROM {{triples}} a JOIN {{triples}} b ON b.s = a.s AND b.p = '{MESHV}identifier'
    JOIN {{triples}} c ON c.s = a.s AND c.p = '{MESHV}preferredTerm'
    JOIN {{triples}} d ON d.s = c.o AND d.p = '{MESHV}prefLabel'
    WHERE a.p = '{RDF_TYPE}' AND a.o = '{MESHV}Concept'""",
)
def bgp_match(t):
    rows = t.triples
    concepts = graph.match(rows, RDF_TYPE, "term", "type").filter(F.col("type") == f"{MESHV}Concept")
    return graph.bgp(
        concepts.drop("type"),
        graph.match(rows, f"{MESHV}identifier", "term", "id"),
        graph.match(rows, f"{MESHV}preferredTerm", "term", "label_node"),
        graph.match(rows, f"{MESHV}prefLabel", "label_node", "name"),
    ).select("term", "id", "label_node", "name")


@query(
    "optional_join",
    f"""SELECT l.s AS iri, l.o AS name, u.o AS subset FROM {{triples}} l
    LEFT JOIN {{triples}} u ON u.s = l.s AND u.p = '{OIO}inSubset'
    WHERE l.p = '{RDFS_LABEL}' AND l.g = '{ANATOMY}'""",
)
def optional_join(t):
    rows = t.triples
    labels = graph.match(rows.filter(F.col("g") == ANATOMY), RDFS_LABEL, "iri", "name")
    return graph.optional(labels, graph.match(rows, f"{OIO}inSubset", "iri", "subset"))


@query(
    "exists_in_graph",
    f"""SELECT s AS iri, o AS name FROM {{triples}} l WHERE p = '{RDFS_LABEL}' AND g = '{ANATOMY}'
    AND EXISTS (SELECT 1 FROM {{triples}} x WHERE x.s = l.s AND x.p = '{RDFS_LABEL}' AND x.g = '{COLLECTION}')""",
)
def exists_in_graph(t):
    rows = t.triples
    labels = graph.match(rows.filter(F.col("g") == ANATOMY), RDFS_LABEL, "iri", "name")
    return graph.exists_in_graph(labels, rows, COLLECTION, RDFS_LABEL)


_ALTERNATIVES = [f"{OIO}hasExactSynonym", f"{SKOS}altLabel", f"{SKOS}prefLabel"]
_IN = ", ".join(f"'{p}'" for p in _ALTERNATIVES)


@query("path_alternative", f"SELECT s, o FROM {{triples}} WHERE p IN ({_IN})")
def path_alternative(t):
    return graph.match(t.triples, _ALTERNATIVES)


@query(
    "group_concat_synonyms",
    f"""SELECT s AS iri, string_agg(o, '; ' ORDER BY o) AS aka
    FROM (SELECT DISTINCT s, o FROM {{triples}} WHERE p IN ({_IN})) GROUP BY s""",
)
def group_concat_synonyms(t):
    return graph.joined_values(t.triples, _ALTERNATIVES, "iri")


@query("closure_part_of", "SELECT node FROM {part_closure}")
def closure_part_of(t):
    merged = graph.merge_graphs(t.triples, [COLLECTION, REDUNDANT])
    return graph.descendants(graph.match(merged, PART_OF, "child", "parent"), t.derived("part_seeds"))


@query(
    "closure_tree_number",
    f"""SELECT DISTINCT s AS descriptor FROM {{triples}} WHERE p = '{MESHV}treeNumber'
    AND o IN (SELECT node FROM {{tree_closure}})""",
)
def closure_tree_number(t):
    return extraction.tree_descendants(t.triples, t.derived("heading_roots"))


@query(
    "union_all_roots",
    f"""SELECT DISTINCT s AS descriptor FROM {{triples}} WHERE p = '{MESHV}treeNumber'
    AND o IN (SELECT node FROM {{tree_closure}})""",
)
def union_all_roots(t):
    # One branch per root would repeat shared subtrees; all roots are one seed frame.
    roots = t.derived("heading_roots")
    twice = roots.unionByName(roots)
    return extraction.tree_descendants(t.triples, twice)


@query(
    "closure_broader",
    f"""SELECT DISTINCT o AS term FROM {{triples}} WHERE p = '{MESHV}preferredConcept'
    AND s IN (SELECT node FROM {{broader_closure}})""",
)
def closure_broader(t):
    return extraction.broader_descendants(t.triples, t.derived("concept_seeds"))


# Extraction ------------------------------------------------------------------------------------


def _terms_sql(graphs, id_sql, synonyms, where):
    """Term extraction as one statement over the merged graphs."""
    listed = ", ".join(f"'{g}'" for g in graphs)
    names = ", ".join(f"'{p}'" for p in synonyms)
    return f"""WITH merged AS (SELECT DISTINCT s, p, o FROM {{triples}} WHERE g IN ({listed}))
    SELECT DISTINCT l.s AS iri, {id_sql} AS id, l.o AS name, a.aka,
      coalesce(d1.o, d2.o, l.o) AS description
    FROM merged l
    LEFT JOIN (SELECT s, string_agg(o, '; ' ORDER BY o) AS aka
      FROM (SELECT DISTINCT s, o FROM merged WHERE p IN ({names})) GROUP BY s) a ON a.s = l.s
    LEFT JOIN merged u ON u.s = l.s AND u.p = '{OIO}inSubset'
    LEFT JOIN merged d1 ON d1.s = l.s AND d1.p = '{OBO}IAO_0000115'
    LEFT JOIN merged d2 ON d2.s = l.s AND d2.p = '{OBO}UBPROP_0000010'
    WHERE l.p = '{RDFS_LABEL}' AND {where}"""


_SYNONYM = [f"{OIO}hasExactSynonym"]
_UBERON_ID = f"replace(l.s, '{OBO}UBERON_', 'UBERON_')"
_OBO_ID = f"replace(l.s, '{OBO}', '')"
_BOTH_ID = f"replace(replace(l.s, '{OBO}', ''), 'http://identifiers.org/hgnc/', 'HGNC_')"


@query(
    "extract_terms_collection",
    _terms_sql(
        [ANATOMY], _UBERON_ID, _SYNONYM,
        f"starts_with(l.s, '{OBO}UBERON_') AND l.s IN (SELECT s FROM {{triples}} "
        f"WHERE p = '{RDFS_LABEL}' AND g = '{COLLECTION}')",
    ),
)
def extract_terms_collection(t):
    return extraction.extract_terms(
        t.triples, [ANATOMY], namespace=extraction.UBERON,
        id_rules={extraction.UBERON: "UBERON_"}, present_in=COLLECTION,
    )


@query(
    "extract_terms_human",
    _terms_sql(
        [ANATOMY, CELLS], _OBO_ID, _SYNONYM,
        f"NOT contains(l.o, 'obsolete ') AND (u.o = '{HUMAN}' OR starts_with({_OBO_ID}, 'CL_'))",
    ),
)
def extract_terms_human(t):
    return extraction.extract_terms(
        t.triples, [ANATOMY, CELLS], id_rules={extraction.OBO: ""},
        subset=extraction.HUMAN_SUBSET, subset_prefixes=["CL_"], drop_obsolete=True,
    )


@query(
    "extract_terms_multi_vocabulary",
    _terms_sql(
        [ANATOMY, CELLS, GENES], _BOTH_ID, _ALTERNATIVES,
        f"NOT contains(l.o, 'obsolete ') AND (u.o = '{HUMAN}' OR starts_with({_BOTH_ID}, 'CL_') "
        f"OR starts_with({_BOTH_ID}, 'HGNC_'))",
    ),
)
def extract_terms_multi_vocabulary(t):
    return extraction.extract_terms(
        t.triples, [ANATOMY, CELLS, GENES],
        id_rules={extraction.OBO: "", extraction.HGNC: "HGNC_"}, synonyms=_ALTERNATIVES,
        subset=extraction.HUMAN_SUBSET, subset_prefixes=["CL_", "HGNC_"], drop_obsolete=True,
    )


@query(
    "extract_terms_part_of",
    _terms_sql(
        [COLLECTION, REDUNDANT], _UBERON_ID, _SYNONYM,
        f"starts_with(l.s, '{OBO}UBERON_') AND l.s IN (SELECT node FROM {{part_closure}})",
    ),
)
def extract_terms_part_of(t):
    return extraction.extract_terms(
        t.triples, [COLLECTION, REDUNDANT], namespace=extraction.UBERON,
        id_rules={extraction.UBERON: "UBERON_"}, part_of=t.derived("part_seeds"),
    )


def _concepts_sql(lead, source):
    return f"""SELECT DISTINCT {lead} c.term AS iri, i.o AS id, n.o AS name, a.aka,
      coalesce(d.o, n.o) AS description
    FROM ({source}) c
    JOIN {{triples}} k ON k.s = c.term AND k.p = '{RDF_TYPE}' AND k.o = '{MESHV}Concept'
    JOIN {{triples}} i ON i.s = c.term AND i.p = '{MESHV}identifier'
    JOIN {{triples}} e ON e.s = c.term AND e.p = '{MESHV}preferredTerm'
    JOIN {{triples}} n ON n.s = e.o AND n.p = '{MESHV}prefLabel'
    LEFT JOIN (SELECT s, string_agg(DISTINCT o, '; ' ORDER BY o) AS aka FROM {{triples}}
      WHERE p = '{MESHV}altLabel' GROUP BY s) a ON a.s = e.o
    LEFT JOIN {{triples}} d ON d.s = c.term AND d.p = '{MESHV}scopeNote'"""


_BELOW = f"""SELECT DISTINCT t.s AS descriptor, x.o AS descriptor_id, p.o AS term FROM {{triples}} t
  JOIN {{triples}} x ON x.s = t.s AND x.p = '{MESHV}identifier'
  JOIN {{triples}} p ON p.s = t.s AND p.p = '{MESHV}preferredConcept'
  WHERE t.p = '{MESHV}treeNumber' AND t.o IN (SELECT node FROM {{tree_closure}})"""


@query("extract_headings", _concepts_sql("", _BELOW))
def extract_headings(t):
    return extraction.extract_headings(t.triples, t.derived("heading_roots"))


@query("extract_descriptors", _concepts_sql("c.descriptor, c.descriptor_id,", _BELOW))
def extract_descriptors(t):
    return extraction.extract_headings(t.triples, t.derived("heading_roots"), with_descriptor=True)


@query(
    "extract_concepts",
    _concepts_sql(
        "",
        f"SELECT DISTINCT o AS term FROM {{triples}} WHERE p = '{MESHV}preferredConcept' "
        f"AND s IN (SELECT node FROM {{broader_closure}})",
    ),
)
def extract_concepts(t):
    return extraction.extract_concepts(t.triples, t.derived("concept_seeds"))
